"""Registered queries of the panel's further inputs: priors in one pass, encoder texts, search traces, exports, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.functions import text as tx
from lexigauge.functions import unicode as un
from lexigauge.operators import answers as an
from lexigauge.operators import concentration as co
from lexigauge.operators import integrity as it
from lexigauge.operators import live as lv
from lexigauge.operators import panel as pa
from lexigauge.operators import profile as pr
from lexigauge.operators import rates as ra
from lexigauge.operators import resampling as rs
from lexigauge.plans import design as de
from lexigauge.plans.lab_catalogue import draws_sql
from lexigauge.plans.registry import query
from lexigauge.sources import corpus as c
from lexigauge.sources import export as ex
from lexigauge.sources import texts as t
from lexigauge.sources.corpus import oracle, table
from lexigauge.sources.texts import REGISTRY, mentioned_sql, texts_oracle

# ---- priors ---------------------------------------------------------------------------------------------------------
_CASES = {"prior_top_off": ("y_top", "condition = 'search_off' and response_decided = 1"), "prior_mention_off": ("y_mention", "condition = 'search_off'"), "prior_top_all": ("y_top", "response_decided = 1"), "prior_mention_all": ("y_mention", "true")}


def _prior(name: str, label: str, only: str) -> str:
    """One prior over the training rows, by category and brand, and its base by category."""
    return f"""{name}_ as (
  select category, brand, sum({label}) as h, count(*) as n from train where {only} group by 1, 2),
{name}_base as (select category, sum(h) / cast(sum(n) as double) as base from {name}_ group by 1)"""


_VALUES = ", ".join(f"round(coalesce(case when coalesce({n}_.n, 0) = 0 then {n}_base.base else ({n}_.h + 10 * {n}_base.base) / ({n}_.n + 10) end, 0), 6) as {n}" for n in _CASES)
_JOINS = " ".join(f"left join {n}_ on {n}_.category = k.category and {n}_.brand = k.brand left join {n}_base on {n}_base.category = k.category" for n in _CASES)


@query(oracle(
    f"select k.category, k.brand, k.n as pairs, {_VALUES} from (select category, brand, count(*) as n from pairs group by 1, 2) k {_JOINS}",
    "train as (select * from pairs where query_id not like '%\\_03' escape '\\')", *[_prior(n, *x) for n, x in _CASES.items()],
))
def four_priors(s, d):
    """All priors of every candidate, fitted without the queries that one fold holds out."""
    panel = pa.tallied(c.folded(s, d), c.registry(s, d), ["category", "query_id", "condition", "response_decided"], ["y_mention", "y_top"])
    rows = pa.add_priors(panel, ~F.endswith("query_id", F.lit("_03")), "m")
    return rows.groupBy("category", "brand").agg(F.sum("m").alias("pairs"), *[F.max(n).alias(n) for n in _CASES])


# ---- encoder texts --------------------------------------------------------------------------------------------------
_BRANDS = ", ".join(repr(b) for b in dict.fromkeys(b for b, _ in REGISTRY))
_BLANK = "(?i)" + "|".join(sorted({f for _, f in REGISTRY if len(f) >= 4}, key=lambda f: (-len(f), f)))


@query(texts_oracle(
    f"""select p.record_id, p.brand, p.n, md5(q.text_a) as text_a, md5(concat(p.brand, ' : ', s)) as text_b, md5(concat('[BRAND] : ', regexp_replace(s, '{_BLANK}', '[BRAND]', 'g'))) as text_b_masked
    from named p join queries q using (record_id)""",
    f"""named as (
  select record_id, brand, count(*) as n, string_agg(text, ' ' order by position) as s from (select *, unnest({mentioned_sql('text')}) as brand from result_texts) group by 1, 2),
queries as (select record_id, arg_min(text, position) as text_a from result_texts group by 1)""",
))
def encoder_texts(s, d):
    """Both texts of every named candidate, with its name and without: the first turn asks, all turns that name it tell."""
    found = t.result_texts(s, d)
    named = an.result_mentions(found.select("record_id", "text"), REGISTRY).groupBy("record_id", "brand").agg(F.count(F.lit(1)).alias("n"))
    asked = found.groupBy("record_id").agg(F.min_by("text", "position").alias("query_text"))
    rows = lv.encoder_texts(named, asked, an.snippets(found, REGISTRY).drop("n_snippets"), REGISTRY)
    return rows.select("record_id", "brand", "n", *[F.md5(x).alias(x) for x in ("text_a", "text_b", "text_b_masked")])


# ---- texts ----------------------------------------------------------------------------------------------------------
#: Terms of the given texts that stand in for those of search queries.
TERMS = {"comparison": (" of ", " que "), "brands": ("keit", "tion"), "current": (" und ", "ment")}
_HAS = {k: " or ".join(f"contains(q, '{x}')" for x in v) for k, v in TERMS.items()}


@query(texts_oracle(f"""select record_id, count(*) as num_searches, count(distinct position) as num_search_rounds, cast(sum(length(text) % 7) as bigint) as num_search_results_returned,
  bool_or(regexp_matches(text, '\\b(19|20)[0-9]{{2}}\\b')) as query_contains_year, bool_or({_HAS['comparison']}) as query_contains_comparison_terms, bool_or({_HAS['brands']}) as query_contains_brand_names,
  bool_or({_HAS['current']}) as query_contains_currentness_terms from (select *, concat(' ', lower(text), ' ') as q from result_texts) group by 1"""))
def search_traces(s, d):
    """What every conversation has searched for: its user's turns are the queries."""
    rows = t.result_texts(s, d).groupBy("record_id").agg(F.collect_list(F.struct(F.col("position").alias("round"), F.col("text").alias("query"), (F.length("text") % 7).cast("long").alias("n"))).alias("calls"))
    found = F.transform("calls", lambda x: x["n"])
    return rows.select("record_id", *tx.search_trace(F.col("calls"), found, TERMS["comparison"], TERMS["brands"], TERMS["current"]))


@query(f"select doc_id, md5({t.KEY_SQL.format('nfc_normalize(text)')}) as key, length(nfc_normalize(text)) as chars from documents")
def compatible_keys(s, d):
    """Keys of whole documents in compatibility form (the given texts have composed letters, but no other variants)."""
    rows = table(s, d, "documents").select("doc_id", un.compatible(F.col("text")).alias("text"))
    return rows.select("doc_id", F.md5(tx.comparison_key(F.col("text"))).alias("key"), F.length("text").cast("long").alias("chars"))


# ---- exports and sources --------------------------------------------------------------------------------------------
_CALLS = "to_json(list({'round': position, 'function': kind, 'query': brand} order by position))"
_FOUND = "to_json(list({'position': position, 'link': host} order by position))"


@query(oracle(
    """select cast(r.record_id as varchar) as record_id, 'tables' as experiment_id, model_id, 'given' as provider, condition, category, 'en' as language, query_id, concat('Which of ', category, '?') as query_text,
      cast(0 as bigint) as run_index, cast(0 as double) as temperature, w.top as final_response, t.calls as tool_calls, t.found as search_results, to_json({'top': w.top}) as core, category as domain,
      case when condition = 'search_on' then 'yes' end as search_aware, cast(t.n as varchar) as deterministic, 'rule' as judge_model, '1' as judge_prompt_version
    from responses r join winners w using (record_id) join told t using (record_id) where year(cast(asked as date)) < 1998 and t.n % 2 = length(w.top) % 2""",
    f"told as (select record_id, count(*) as n, {_CALLS} as calls, {_FOUND} as found from results group by 1)",
))
def fixed_export(s, d):
    """Planned answers with a current judgement in the fixed schema: those of before 1998 are planned, a judgement is
    current where the parity of its results is that of the winner's name."""
    found = c.results(s, d)
    calls = F.array_sort(F.collect_list(F.struct("position", "kind", "brand", "host")))
    told = found.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), calls.alias("calls"))
    call = F.transform("calls", lambda x: F.struct(x["position"].alias("round"), x["kind"].alias("function"), F.struct(x["brand"].alias("query")).alias("arguments")))
    results = F.to_json(F.transform("calls", lambda x: F.struct(x["position"].alias("position"), x["host"].alias("link"))))
    raw = c.responses(s, d).join(told, "record_id").select(
        "record_id", F.lit("tables").alias("experiment_id"), "model_id", F.lit("given").alias("provider"), "condition", "category", F.lit("en").alias("language"), "query_id", F.concat(F.lit("Which of "), "category", F.lit("?")).alias("query_text"),
        F.lit(0).alias("run_index"), F.lit(0.0).alias("temperature"), ex.tool_calls(call).alias("tool_calls"), results.alias("search_results"), F.col("category").alias("domain"), F.when(F.col("condition") == "search_on", "yes").alias("search_aware"),
        F.col("n").cast("string").alias("deterministic"), (F.col("n") % 2).alias("content_hash"),
    )
    judged = c.winners(found).select("record_id", F.col("top").alias("final_response"), F.to_json(F.struct("top")).alias("core"), F.lit("rule").alias("judge_model"), F.lit("1").alias("judge_prompt_version"), (F.length("top") % 2).cast("long").alias("content_hash"))
    return ex.export_rows(raw, judged, c.responses(s, d).where(F.year("asked") < 1998))


@query(oracle("""select category, brand, host, kind, answers, best, title, link, cast(rank as integer) as rank from (
  select *, row_number() over (partition by category, brand order by answers desc, host, kind) as rank from (
    select category, brand, host, kind, count(distinct record_id) as answers, min(position) as best, arg_min(link, row(position, record_id, link)) as link, arg_min(title, row(position, record_id, link)) as title
    from (select r.*, category, concat('https://www.', host, '/p/', position) as link, concat(brand, ' in ', kind) as title from results r join responses a using (record_id) where condition = 'search_on') group by 1, 2, 3, 4)) where rank <= 12"""))
def brand_source_pages_topk(s, d):
    """The hosts that speak of a brand in most answers, with title and link of their first page."""
    rows = c.results(s, d).join(c.responses(s, d).where("condition = 'search_on'").select("record_id", "category"), "record_id")
    link = F.concat(F.lit("https://www."), "host", F.lit("/p/"), F.col("position").cast("string"))
    return pr.brand_sources(rows.withColumns({"link": link, "title": F.concat("brand", F.lit(" in "), "kind")}))


# ---- intervals of concentration -------------------------------------------------------------------------------------
_SCOPE = "category, condition, model_id"
_POINT = """select {keys}, round(1 / h, 9) as effective_brands, round(top / t, 9) as top_share, case when brands > 1 then round((h - 1.0e0 / brands) / (1 - 1.0e0 / brands), 9) end as normalised_hhi
  from (select {keys}, cast(sum(n) as double) as t, sum(n * n) / (cast(sum(n) as double) * sum(n)) as h, sum(n) filter (where place <= 3) as top
    from (select *, row_number() over (partition by {keys} order by n desc, brand) as place from {of} where n > 0) group by all) join brands_ using (category)"""
_MEASURES = ("effective_brands", "top_share", "normalised_hhi")


@query(oracle(
    f"""select {_SCOPE}, brands, events, brands - named as never_named, coalesce(queries, 0) as queries,
      {', '.join(f"round({m}, 6) as {m}, case when queries > 1 then {m}_low end as {m}_low, case when queries > 1 then {m}_high end as {m}_high" for m in _MEASURES)}
    from sizes join brands_ using (category) left join usable using ({_SCOPE}) left join point using ({_SCOPE}) left join ends using ({_SCOPE})""",
    f"""events_ as (
  select category, condition, coalesce(model_id, 'ALL') as model_id, query_id, brand, cast(sum(y_mention) as bigint) as n
  from pairs group by grouping sets ((category, condition, model_id, query_id, brand), (category, condition, query_id, brand)))""",
    "brands_ as (select category, count(distinct brand) as brands from pairs group by 1)",
    f"totals as (select {_SCOPE}, brand, sum(n) as n from events_ group by all)",
    f"sizes as (select {_SCOPE}, cast(sum(n) as bigint) as events, count(*) filter (where n > 0) as named from totals group by all)",
    f"usable as (select {_SCOPE}, count(distinct query_id) as queries from events_ where n > 0 group by all)",
    "point as (" + _POINT.format(keys=_SCOPE, of="totals") + ")",
    draws_sql("pairs", "category, condition", "query_id", 400),
    f"drawn as (select {_SCOPE}, draw, brand, sum(n * times) as n from events_ join times using (category, condition, query_id) where n > 0 group by all)",
    "values_ as (" + _POINT.format(keys=f"{_SCOPE}, draw", of="drawn") + ")",
    f"ends as (select {_SCOPE}, {', '.join(f'round(quantile_cont({m}, {q}), 6) as {m}_{tag}' for m in _MEASURES for q, tag in ((0.025, 'low'), (0.975, 'high')))} from values_ group by all)",
))
def concentration_intervals(s, d):
    """The concentration cube with the intervals of its three measures, from the same 400 draws of queries, in one row."""
    return rs.concentration_intervals(c.pairs(s, d), 400)


@query(oracle("""select category, condition, query_id, brand, count(record_id) as answers, round(avg(cast(y_mention as double)), 6) as rate
  from (select distinct category, condition, query_id from pairs) join (select distinct category, brand from pairs) using (category) left join pairs using (category, condition, query_id, brand) group by 1, 2, 3, 4"""))
def rate_matrix(s, d):
    """Mention rates of every query, condition and brand."""
    return co.rate_matrix(c.pairs(s, d))


@query(oracle("""select category, cast(sum(n) as bigint) as answers, string_agg(concat(condition, '=', n), ',' order by condition) as conditions, round(sum(s) / cast(sum(n) as double), 4) as single_winner_rate, round(sum(w) / cast(sum(n) as double), 2) as mean_words
  from (select category, condition, count(*) as n, count(top) as s, coalesce(sum(m), 0) as w from answers left join (select record_id, count(*) as m from results group by 1) using (record_id) group by 1, 2) group by 1"""))
def market_summary(s, d):
    """Answers of every market: conditions, single winners, mean length (their results stand in for words)."""
    size = c.results(s, d).groupBy("record_id").agg(F.count(F.lit(1)).alias("words"))
    rows = c.answers(s, d).join(size, "record_id", "left")
    return ra.market_summary(rows.withColumn("single", F.col("top").isNotNull()))


# ---- designs --------------------------------------------------------------------------------------------------------
def _inserted(rank: int, of: str) -> str:
    return f"""select record_id, case when position >= {rank} then position + 1 else position end as position, host from {of}
  union all select record_id, least({rank}, max(position) + 1), 'inserted.example.com' from {of} group by 1"""


@query(oracle(
    " union all ".join(f"select record_id, '{arm}' as arm, cast(position as integer) as position, host from {of}" for arm, of in (("control", "base"), ("neutral_p1", "p1"), ("superlative_p5", "p5"), ("neutral_p5", "p5"), ("neutral_p5_p8", "p58"))),
    "base as (select record_id, row_number() over (partition by record_id order by position) as position, host from results)",
    "p1 as (" + _inserted(1, "base") + ")", "p5 as (" + _inserted(5, "base") + ")", "p58 as (" + _inserted(8, "p5") + ")",
))
def arm_lists(s, d):
    """The results of every answer as each of five arms shows them."""
    return de.arm_lists(c.results(s, d))


_VARIANTS = ["price", "authority", "certificate"]


@query(oracle(
    """select job_id, category, identity, variant, rep, cast(place + case when place >= target_at then 1 else 0 end as integer) as position, brand from others
    union all select job_id, category, identity, variant, rep, target_at, null from calls""",
    f"""cells_ as (
  select category, identity, 'control' as variant from (select distinct category from responses) cross join (select unnest(['incumbent', 'small', 'fictional']) as identity)
  union all select category, 'fictional', variant from (select distinct category from responses) cross join (select unnest([{', '.join(repr(v) for v in _VARIANTS)}]) as variant)),
calls as (
  select category, identity, variant, rep, concat_ws('__', category, identity, variant) || '__r' || rep as job_id,
    cast((rep + cast('0x' || substr(sha256(concat_ws('__', category, identity, variant)), 1, 8) as bigint)) % 5 + 1 as integer) as target_at
  from cells_ cross join (select cast(range as integer) as rep from range(5))),
shown as (select category, brand from (select category, brand, row_number() over (partition by category order by brand) as n from (select distinct category, brand from results join responses using (record_id))) where n <= 4),
others as (select *, row_number() over (partition by job_id order by md5(concat_ws('|', job_id, brand)), brand) as place from calls join shown using (category))""",
))
def lab_cards(s, d):
    """The cards of every call of the lab: shuffled competitors, and the target at each position once in five."""
    answers = c.responses(s, d)
    competitors = c.results(s, d).join(answers.select("record_id", "category"), "record_id").select("category", "brand")
    return de.lab_cards(de.lab_cells(answers.select("category").distinct(), _VARIANTS), competitors, 5)


# ---- records and functions ------------------------------------------------------------------------------------------
@query("""with c as (select user_id as model, event_id as id, ts, event_type = 'error' as failed, coalesce(event_type = 'error' and (value < 1 or 400 + cast(floor(value) as integer) in (401, 402, 403, 404, 410, 429)), false) as disables from events),
f as (select model, min(row(ts, id)) as first, arg_min(id, row(ts, id)) as trigger from c where failed and disables group by 1)
select f.model, trigger, epoch_us(any_value(c.ts) filter (where c.id = trigger)) as at_us, count(*) filter (where failed and row(c.ts, c.id) <= first) as failures, count(*) filter (where row(c.ts, c.id) > first) as skipped
from f join c on c.model = f.model group by f.model, trigger""")
def disabled_models(s, d):
    """Users as models: the failure that takes each out, by class (400 and its value as code, under 1 no connection)."""
    rows = table(s, d, "events")
    error = F.col("event_type") == "error"
    calls = rows.select(F.col("user_id").alias("model"), F.col("event_id").alias("id"), F.col("ts").alias("at"), error.alias("failed"), it.disabling(F.lit(400) + F.floor("value").cast("int"), F.col("value") < 1, F.lit(False)).alias("disables"))
    return it.disabled(calls).select("model", "trigger", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "failures", "skipped")


@query(f"""select conv_id, turn, md5({t.KEY_SQL.format('text')}) as comparison, md5({t.TEXT_KEY_SQL.format('text')}) as words, md5(lower(translate(text, 'Iİ', 'ıi'))) as turkish,
  md5(regexp_replace(regexp_replace(lower(translate(text, 'İIı', 'iii')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) as slug from conversations""")
def registered_functions(s, d):
    """Keys of every turn by the functions as they are called from SQL."""
    tx.register(s)
    table(s, d, "conversations").createOrReplaceTempView("_turns")
    return s.sql("select conv_id, turn, md5(comparison_key(text)) as comparison, md5(text_key(text)) as words, md5(turkish_casefold(text)) as turkish, md5(slug(text)) as slug from _turns")
