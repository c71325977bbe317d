"""Registered queries of the live side, of candidates' language, and of models over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators import answers as an
from lexigauge.operators import live as lv
from lexigauge.operators import models as mo
from lexigauge.operators import panel as pa
from lexigauge.operators import profile as pr
from lexigauge.plans.registry import query
from lexigauge.sources import corpus as c
from lexigauge.sources import texts as t
from lexigauge.sources.corpus import oracle, table
from lexigauge.sources.texts import REGISTRY, TARGET, distinct_sql, mentioned_sql, names_sql, texts_oracle

#: Terms that occur in the given texts.
LEXICON = {"authority": ["the", "und"], "social_proof": ["of", "la"], "specificity": ["with", "der"], "hedging": ["from", "nicht"], "superlative": ["in", "que"]}
RANKED = ["authority_rate", "social_proof_rate", "specificity_rate", "hedging_rate", "superlative_rate", "words_per_snippet", "digit_share", "has_year"]
_BRANDS = ", ".join(repr(b) for b in dict.fromkeys(b for b, _ in REGISTRY))
_SNIPPETS = f"""snippets as (select record_id, brand, coalesce(n, 0) as n_snippets, coalesce(s, '') as snippet from (select distinct record_id from result_texts) cross join (select unnest([{_BRANDS}]) as brand)
  left join (select record_id, brand, count(*) as n, string_agg(text, ' ' order by position) as s from (select *, unnest({mentioned_sql('text')}) as brand from result_texts) group by 1, 2) using (record_id, brand))"""
_COUNT = {g: " + ".join(f"cast((length(k) - length(replace(k, ' {x} ', ''))) / {len(x) + 2} as bigint)" for x in terms) for g, terms in LEXICON.items()}
_LANGUAGE = f"""language as (select record_id, brand, n_snippets, {', '.join(f'round(({x}) / cast(greatest(n_snippets, 1) as double), 6) as {g}_rate' for g, x in _COUNT.items())}, round(len(list_filter(string_split(trim(k), ' '), lambda w: w <> '')) / cast(greatest(n_snippets, 1) as double), 6) as words_per_snippet,
  round(coalesce(length(regexp_replace(snippet, '[^0-9]', '', 'g')) / nullif(cast(length(snippet) as double), 0), 0), 6) as digit_share, cast(regexp_matches(snippet, '(^|[^0-9A-Za-z_])(19|20)[0-9]{{2}}([^0-9A-Za-z_]|$)') as bigint) as has_year from (select *, {t.TEXT_KEY_SQL.format('snippet')} as k from snippets))"""


def _snippets(s: SparkSession, d: str) -> DataFrame:
    return an.snippets(t.result_texts(s, d), REGISTRY)


# ---- language of candidates -----------------------------------------------------------------------------------------
@query(texts_oracle("select * from language", _SNIPPETS, _LANGUAGE))
def snippet_features(s, d):
    return lv.language(_snippets(s, d), LEXICON)


_PCT = ", ".join(f"round(case when n_snippets > 0 then (rank() over (partition by record_id, n_snippets > 0 order by {x}) + (count(*) over (partition by record_id, n_snippets > 0, {x}) - 1) / 2.0) / count(*) over (partition by record_id, n_snippets > 0) else 0 end, 6) as {x}_pct" for x in RANKED)


@query(texts_oracle(f"select record_id, brand, {_PCT} from language", _SNIPPETS, _LANGUAGE))
def language_ranks(s, d):
    """Where a candidate's language stands among the retrieved candidates of its answer."""
    return lv.language_ranks(lv.language(_snippets(s, d), LEXICON), RANKED)


@query(texts_oracle(f"select record_id, brand, n, length(snippet) as chars from (select record_id, brand, count(*) as n from (select record_id, unnest({mentioned_sql('text')}) as brand from result_texts) group by 1, 2) join snippets using (record_id, brand)", _SNIPPETS))
def encoder_inputs(s, d):
    """Rows of a panel with their snippets, every row matched once."""
    panel = an.result_mentions(t.result_texts(s, d).select("record_id", "text"), REGISTRY).groupBy("record_id", "brand").agg(F.count(F.lit(1)).alias("n"))
    return lv.encoder_inputs(panel, _snippets(s, d).drop("n_snippets")).select("record_id", "brand", "n", F.length("snippet").cast("long").alias("chars"))


@query(oracle("""select category, brand, count(*) as rows, any_value(prior) as prior from pairs join (select category, brand, round((sum(y_top) + 10 * any_value(base)) / (count(*) + 10), 6) as prior from pairs join (select category, avg(cast(y_top as double)) as base from pairs group by 1) using (category) group by 1, 2) using (category, brand) group by 1, 2"""))
def attached_priors(s, d):
    """Every candidate row with the prior of its brand; a brand without one stops the query."""
    panel = c.pairs(s, d)
    rows = lv.with_priors(panel, pa.priors(panel, ["category"], "y_top"), ["category", "brand"])
    return rows.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("rows"), F.max("prior").alias("prior"))


# ---- outreach and recommendations -----------------------------------------------------------------------------------
PLATFORMS = ["site2.example.com"]


@query(texts_oracle(f"""select market, host, rivals, position, cast(rank as integer) as rank from (select *, row_number() over (partition by market order by rivals desc, coalesce(position, 99), host) as rank from (
  select market, host, cast(max(rivals) as integer) as rivals, arg_min(position, -rivals * 1000 + coalesce(position, 99)) as position from (select market, host, position, len({distinct_sql('names')}) as rivals from (select concat('m', record_id % 5) as market, host, position, {names_sql('text')} as names from result_texts)
  where len(names) > 0 and not list_contains(names, '{TARGET}') and not contains(host, 'site3') and not contains(host, 'site5') and host <> '{PLATFORMS[0]}') group by 1, 2)) where rank <= 3"""))
def live_outreach_topk(s, d):
    """Sites of a market that name rivals and never the target."""
    rows = t.result_texts(s, d).withColumn("market", F.concat(F.lit("m"), (F.col("record_id") % 5).cast("string")))
    return lv.outreach(rows, REGISTRY, TARGET, t.OWN, PLATFORMS, "market", 3)


HINTS = (("/en/", 3), ("html", 2), ("utm", -2), ("page=", 1))


@query("""select host, url, score, cast(rank as integer) as rank from (select *, row_number() over (partition by host order by score desc, length(url), url) as rank from (select distinct host, url, """ + " + ".join(f"case when contains(lower(url), '{h}') then {n} else 0 end" for h, n in HINTS) + """ as score from (select url, regexp_extract(lower(url), '^https?://([^/:?#@]+)', 1) as host from pages)) where score > 0) where rank <= 3""")
def product_links_topk(s, d):
    """The links of a site that look most like products."""
    rows = table(s, d, "pages").select("url", F.regexp_extract(F.lower("url"), "^https?://([^/:?#@]+)", 1).alias("host"))
    return lv.product_links(rows, HINTS, "host")


@query(oracle("select query_id, host, position, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by position, host) as rank from (select query_id, host, min(position) as position from results join responses using (record_id) group by 1, 2)) where rank <= 3"))
def distinct_sources_topk(s, d):
    """The first three sources of a query, repeats left out."""
    rows = c.results(s, d).join(c.responses(s, d).select("record_id", "query_id"), "record_id")
    return lv.first_of_each(rows, "query_id", "host", "position")


ADVICE = (("presence", "be listed on independent pages"), ("results_per_answer", "be named by several sources"), ("rank1_share", "be named on the first results"))
_GAPS = """profile_ as (select category, brand, round(avg(cast(in_search_results as double)), 6) as presence, round(avg(cast(n_results_mentioning as double)), 6) as results_per_answer, round(avg(case when best_position = 1 then 1.0e0 else 0.0e0 end), 6) as rank1_share from pairs where condition = 'search_on' group by 1, 2),
 long_ as (select category, brand, 'presence' as metric, presence as mine from profile_ union all select category, brand, 'results_per_answer', results_per_answer from profile_ union all select category, brand, 'rank1_share', rank1_share from profile_),
 tested_ as (select * from (values ('presence', 0.02, 0.1), ('rank1_share', -0.1, 0.3)) v(metric, low, high))"""


@query(oracle("select category, brand, metric, case metric " + " ".join(f"when '{m}' then '{x}'" for m, x in ADVICE) + " end as title, mine, winners, coalesce(case when low > 0 then 'gain' when high < 0 then 'loss' when low is not null then 'no measurable effect' end, 'not tested') as verdict from (select *, max(mine) over (partition by category, metric) as winners from long_) left join tested_ using (metric) where mine < 0.75 * winners", _GAPS))
def brand_recommendations(s, d):
    """Advice for every brand that lags behind the best of its category, with what its test has measured."""
    rows = c.pairs(s, d).where("condition = 'search_on'").groupBy("category", "brand").agg(
        F.round(F.avg(F.col("in_search_results").cast("double")), 6).alias("presence"), F.round(F.avg(F.col("n_results_mentioning").cast("double")), 6).alias("results_per_answer"),
        F.round(F.avg(F.when(F.col("best_position") == 1, 1.0).otherwise(0.0)), 6).alias("rank1_share"))
    long = rows.unpivot(["category", "brand"], ["presence", "results_per_answer", "rank1_share"], "metric", "mine")
    best = long.groupBy("category", "metric").agg(F.max("mine").alias("winners"))
    effects = s.createDataFrame([("presence", "listed", "control", 0.06, 0.02, 0.1), ("rank1_share", "top", "control", 0.1, -0.1, 0.3)], "scope string, arm string, base string, effect double, low double, high double")
    verdicts = lv.tested(effects, "listed", "control").unionByName(lv.tested(effects, "top", "control")).withColumnRenamed("scope", "metric")
    return lv.recommendations(long.join(best, ["category", "metric"]), verdicts, ADVICE)


@query(oracle("select brand from (select brand, count(*) as n from results where flag <> 'R' and brand <> 'Brand#7' group by 1 order by n desc, brand limit 5)"))
def comparison_set_topk(s, d):
    """The five rivals that are named most."""
    named = c.results(s, d).where("flag <> 'R'").groupBy("brand").agg(F.count(F.lit(1)).alias("mentions"))
    scores = c.scored(c.pairs(s, d)).groupBy("brand").agg(F.avg("score").alias("score"))
    return pr.comparison_set(named, scores, "Brand#7")


# ---- what models extract --------------------------------------------------------------------------------------------
@query("select c.conv_id, c.turn, q from (select conv_id, turn, case when length(text) % 2 = 0 then substr(text, 5, 20) else 'made up words' end as q, text from conversations) c where length(trim(q)) >= 3 and contains(text, q)")
def grounded_quotes(s, d):
    """Quotes that stand in their source; others are dropped."""
    rows = table(s, d, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    quote = F.when(F.length("text") % 2 == 0, F.substring("text", 5, 20)).otherwise(F.lit("made up words"))
    return lv.grounded(rows.select("key", "conv_id", "turn", quote.alias("q")), rows, "key", "q", "text", 3).select("conv_id", "turn", "q")


@query(texts_oracle(f"""select record_id, name, cast(row_number() over (partition by record_id order by place, name) as integer) as rank from (select a.record_id, n.name, n.place from answer_texts a cross join (select unnest([{', '.join(f"{{'name': '{f}', 'place': {i}}}" for i, (_, f) in enumerate(REGISTRY))}], recursive := true)) n where contains({t.TEXT_KEY_SQL.format('a.text')}, ' ' || lower(n.name) || ' '))"""))
def extracted_names_topk(s, d):
    """Names proposed for an answer that really occur in it."""
    rows = t.answer_texts(s, d)
    proposed = rows.select("record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.lit(i).alias("place")) for i, (_, f) in enumerate(REGISTRY)])).alias("n")).select("record_id", "n.*")
    return lv.extracted(proposed, rows.select("record_id", "text"), "record_id")


@query(oracle("select record_id, case lower(replace(w.top, '#', ' ')) when 'brand 1' then 'first brand' else lower(replace(w.top, '#', ' ')) end as top, array_to_string(m, ',') as mentioned from winners w join (select record_id, list_sort(list(case lower(replace(brand, '#', ' ')) when 'brand 1' then 'first brand' else lower(replace(brand, '#', ' ')) end)) as m from mentions group by 1) using (record_id)"))
def normalised_judgements(s, d):
    """Names inside a judgement as brand keys, aliases resolved."""
    found = c.results(s, d)
    named = c.mentions(found).groupBy("record_id").agg(F.collect_set("brand").alias("mentioned"))
    rows = c.winners(found).join(named, "record_id").select("record_id", F.struct("top", "mentioned").alias("judgement"))
    out = lv.normalised_judgements(rows, "judgement", [("brand 1", "first brand")])
    return out.select("record_id", "judgement.top", F.array_join(F.array_sort("judgement.mentioned"), ",").alias("mentioned"))


@query(oracle("select category, condition, model_id, count(*) as n from scored where (record_id, brand) in (select record_id, brand from mentions) group by 1, 2, 3"))
def compared_tracks(s, d):
    """Rows of the panel that another track, the brands that answers name, has too."""
    rows = lv.seen_by(c.scored(c.pairs(s, d)), c.mentions(c.results(s, d)), ["record_id", "brand"])
    return rows.groupBy("category", "condition", "model_id").agg(F.count(F.lit(1)).alias("n"))


@query(texts_oracle(f"""select g.record_id, g.brand, g.n as n_results, coalesce(h.n, 0) as n_results_mentioning, coalesce(h.p, 99) as best_position, cast(h.p is not null as bigint) as in_search_results, round(coalesce(h.n, 0) / cast(g.n as double), 6) as volume_share, cast(g.brand = '{TARGET}' as bigint) as is_target
  from (select record_id, count(*) as n, unnest([{_BRANDS}]) as brand from result_texts group by 1) g left join (select record_id, brand, count(*) as n, min(position) as p from (select record_id, position, unnest(list_distinct(names)) as brand from (select *, {names_sql('text')} as names from result_texts)) group by 1, 2) h using (record_id, brand)"""))
def live_panel(s, d):
    """The candidate rows of a live request, from its results' texts."""
    return lv.live_panel(t.result_texts(s, d), REGISTRY, TARGET)


# ---- models: no SQL twin --------------------------------------------------------------------------------------------
def _design(s: SparkSession, d: str) -> DataFrame:
    return pa.relative(pa.panel_filter(c.pairs(s, d, sizes=True)), keep=("category", "query_id"))


@query()
def out_of_fold_scores(s, d):
    """Every candidate scored by a logistic model that saw no query of its fold."""
    rows = _design(s, d)
    folds = pa.folds(c.responses(s, d), 3)
    return mo.out_of_fold(rows, folds, 3)


@query()
def leave_one_out_scores(s, d):
    """Every category scored by a model of the others."""
    return mo.leave_one_out(_design(s, d))


@query()
def permutation_drops(s, d):
    """Fall of NDCG when a feature is dealt anew within its category, three times."""
    rows = pa.relative(pa.panel_filter(c.folded(s, d, sizes=True)).where("m > 0"), keep=("category", "query_id", "m"), times="m")
    return mo.permutation_drop(rows, ["volume_share", "position_rank_pct"], repeats=3, brands=c.registry(s, d), times="m")
