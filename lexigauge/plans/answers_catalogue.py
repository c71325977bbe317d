"""Registered queries over texts: names, mentions, snippets, masks, outcomes, guards, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.functions import audit as au
from lexigauge.functions import names as nm
from lexigauge.functions import replies as rp
from lexigauge.functions import text as tx
from lexigauge.functions import urls as ur
from lexigauge.operators import answers as an
from lexigauge.plans.registry import query
from lexigauge.sources import texts as t
from lexigauge.sources.corpus import table
from lexigauge.sources.texts import REGISTRY, TARGET, distinct_sql, mentioned_sql, names_sql, texts_oracle

_ACCENTS = ("çğıöşüâîûàáäãåéèêëíìïóòôõúùñß", "cgiosuaiuaaaaaeeeeiiioooouuns")


# ---- keys and resolution --------------------------------------------------------------------------------------------
@query(f"""select conv_id, turn, md5({t.KEY_SQL.format('text')}) as comparison, md5(lower(translate(text, 'Iİ', 'ıi'))) as turkish,
  md5(regexp_replace(translate(lower(translate(text, 'Iİ', 'ii')), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[^a-z0-9]', '', 'g')) as ascii,
  md5(regexp_replace(regexp_replace(lower(translate(text, 'İIı', 'iii')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) as slug,
  md5(trim(regexp_replace(lower(translate(translate(text, '™®©', ''), 'Iİ', 'ıi')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) as brand,
  md5(regexp_replace(lower(translate(text, 'İ', 'i')), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) as collapsed from conversations""")
def text_keys(s, d):
    keys = {"comparison": tx.comparison_key, "turkish": tx.turkish_casefold, "ascii": tx.ascii_key, "slug": nm.slug, "brand": nm.brand_key, "collapsed": nm.collapsed}
    return table(s, d, "conversations").select("conv_id", "turn", *[F.md5(f(F.col("text"))).alias(k) for k, f in keys.items()])


_RESOLVED = f"resolved as (select record_id, arm, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}]+'), lambda x: case {t.KEY_SQL.format('x')} " + " ".join(f"when '{nm.plain_key(f)}' then '{b}'" for b, f in REGISTRY if b != "Der") + " end), lambda b: b is not null) as names from answer_texts)"


@query(texts_oracle(f"select record_id, array_to_string({distinct_sql('names')}, ',') as brands, case when len(names) > 0 then names[1] end as first from resolved", _RESOLVED))
def resolved_names(s, d):
    """All words of an answer resolved to brands, one brand excluded."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}]+"), F.lit(0))
    brands = nm.resolve_all(words, REGISTRY, ["der"])
    return t.answer_texts(s, d).select("record_id", brands.alias("b")).select("record_id", F.array_join("b", ",").alias("brands"), F.get("b", F.lit(0)).alias("first"))


@query(texts_oracle("select arm, array_to_string(list_sort(list(distinct b)), ',') as brands, count(distinct b) as n from (select arm, unnest(names) as b from resolved) group by 1", _RESOLVED))
def market_brands(s, d):
    """Union of the brands that the answers of an arm name; the registry bounds it."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}]+"), F.lit(0))
    rows = t.answer_texts(s, d).select("arm", F.explode(nm.resolve_all(words, REGISTRY, ["der"])).alias("b"))
    return rows.groupBy("arm").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("brands"), F.countDistinct("b").alias("n"))


# ---- mentions -------------------------------------------------------------------------------------------------------
@query(f"select doc_id, lang, unnest({mentioned_sql('text')}) as brand from documents")
def document_mentions(s, d):
    """Result x brand rows: every whole document as a result, joined to the brands that its text mentions."""
    return an.result_mentions(table(s, d, "documents").select("doc_id", "lang", "text"), REGISTRY)


@query(texts_oracle(f"""select record_id, brand, coalesce(n, 0) as n_snippets, md5(coalesce(s, '')) as snippet from (select distinct record_id from result_texts) cross join (select unnest([{', '.join(repr(b) for b in dict.fromkeys(b for b, _ in REGISTRY))}]) as brand)
  left join (select record_id, brand, count(*) as n, string_agg(text, ' ' order by position) as s from (select *, unnest({mentioned_sql('text')}) as brand from result_texts) group by 1, 2) using (record_id, brand)"""))
def snippet_panel(s, d):
    rows = an.snippets(t.result_texts(s, d), REGISTRY)
    return rows.withColumn("snippet", F.md5("snippet"))


@query(f"select concat_ws('-', conv_id, turn) as key, len(names) as n, names[1] as first, names from (select *, {names_sql('text')} as names from conversations)")
def brand_spans(s, d):
    rows = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), nm.names_in(F.col("text"), REGISTRY).alias("names"))
    return rows.select("key", F.size("names").cast("long").alias("n"), F.get("names", F.lit(0)).alias("first"), "names")


@query(f"""with n as (select *, {names_sql('text')} as names from conversations), o as (select *, list_filter({distinct_sql('names')}, lambda b: b <> '{TARGET}') as others from n)
  select concat_ws('-', conv_id, turn) as key, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '{t.PIECE}'), lambda x: case when {t.brand_sql('x')} is null then x when {t.brand_sql('x')} = '{TARGET}' then '[TARGET_BRAND]' else '[OTHER_BRAND_' || list_position(others, {t.brand_sql('x')}) || ']' end), '') as masked from o""")
def mask_text(s, d):
    return table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), nm.masked(F.col("text"), REGISTRY, TARGET).alias("masked"))


_BLANK = "(?i)" + "|".join(sorted({f for _, f in REGISTRY if len(f) >= 4}, key=lambda f: (-len(f), f)))


@query(f"select doc_id, md5(m) as masked, cast((length(m) - length(replace(m, '[BRAND]', ''))) / 7 as bigint) as n from (select doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}', '[BRAND]', 'g') as m from documents)")
def blanked_documents(s, d):
    """Every form in every whole document as [BRAND]."""
    m = F.col("m")
    rows = table(s, d, "documents").select("doc_id", nm.blanked(F.col("text"), REGISTRY).alias("m"))
    return rows.select("doc_id", F.md5(m).alias("masked"), ((F.length(m) - F.length(F.replace(m, F.lit("[BRAND]"), F.lit("")))) / 7).cast("long").alias("n"))


# ---- what an answer recommends --------------------------------------------------------------------------------------
#: Cues of the given texts: what stands for recommending, and for naming an alternative.
RECOMMENDS, ALTERNATIVE = r"(?i)ing|lich|ment", r"(?i)nicht|with|pour"
_OUT = f"""named as (select *, {names_sql('text')} as names from answer_texts),
 told as (select *, {distinct_sql('names')} as named, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda l: not contains(l, '|')), chr(10)) as prose from named),
 said as (select *, list_filter(list_transform(list_filter(regexp_extract_all(prose, '[^.!?\\n]+'), lambda x: regexp_matches(x, '{RECOMMENDS}') and not regexp_matches(x, '{ALTERNATIVE}')), lambda x: {names_sql('x')}), lambda l: len(list_distinct(l)) = 1) as one,
   list_filter(list_transform(regexp_extract_all(prose, '(?s)\\*\\*(.+?)\\*\\*', 1), lambda x: {names_sql('x')}), lambda l: len(list_distinct(l)) = 1) as bold from told),
 outcome as (select record_id, arm, named, cast(len(named) as bigint) as n_named, named[1] as first_named, coalesce(one[1][1], bold[1][1], named[1]) as first_brand,
   case when one[1][1] is not null then 'sentence' when bold[1][1] is not null then 'bold' when named[1] is not null then 'first_mention' else 'none' end as pick_method from said)"""


def _outcomes(s, d):
    return an.outcomes(t.answer_texts(s, d), REGISTRY, RECOMMENDS, ALTERNATIVE, TARGET)


@query(texts_oracle(f"""select record_id, arm, array_to_string(named, ',') as named, n_named, first_named, first_brand, pick_method, cast(case when first_brand = '{TARGET}' then 1 else 0 end as bigint) as first,
  cast(case when list_contains(named, '{TARGET}') then 1 else 0 end as bigint) as mentioned, nullif(cast(coalesce(list_position(named, '{TARGET}'), 0) as bigint), 0) as rank from outcome""", _OUT))
def answer_outcomes(s, d):
    return _outcomes(s, d).drop("text").withColumn("named", F.array_join("named", ","))


def _added_sql() -> str:
    """The forms of brands that a text nowhere spells right and of which the word x is one letter off, in order.

    DuckDB counts edits of bytes, so letters beyond ASCII, which the forms do not have, are one byte here.
    """
    tests = [
        f"case when not list_contains(list_distinct(names), '{b}') and length(x) >= 5 and substr(lower(x), 1, 1) = '{f[0].lower()}' and damerau_levenshtein(regexp_replace(lower(x), '[^\\x00-\\x7F]', '*', 'g'), '{f.lower()}') = 1"
        f" and (length(x) <> {len(f)} or {len(f)} >= 6) then '{f}' end" for b, f in REGISTRY if len(f) >= 5
    ]
    return ", ".join(tests)


_SPELT = f"""spelt as (
  select record_id, arm, names, {distinct_sql('names')} as named,
    array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '{t.PIECE}'), lambda x: concat_ws(' ', x, {_added_sql()})), '') as spelt
  from (select *, {names_sql('text')} as names from answer_texts)),
pieces as (
  select *, array_to_string(list_filter(regexp_split_to_array(spelt, '\\r?\\n'), lambda l: not contains(l, '|')), chr(10)) as prose, {names_sql('spelt')} as mentions_ from spelt),
picks as (
  select *, list_filter(list_transform(list_filter(regexp_extract_all(prose, '[^.!?\\n]+'), lambda x: regexp_matches(x, '{RECOMMENDS}') and not regexp_matches(x, '{ALTERNATIVE}')), lambda x: {names_sql('x')}), lambda l: len(list_distinct(l)) = 1) as one,
    list_filter(list_transform(regexp_extract_all(prose, '(?s)\\*\\*(.+?)\\*\\*', 1), lambda x: {names_sql('x')}), lambda l: len(list_distinct(l)) = 1) as bold from pieces)"""


@query(texts_oracle(
    """select record_id, arm, array_to_string(named, ',') as named, named[1] as first_named, coalesce(one[1][1], bold[1][1], mentions_[1]) as first_brand, length(spelt) as chars,
      case when one[1][1] is not null then 'sentence' when bold[1][1] is not null then 'bold' when mentions_[1] is not null then 'first_mention' else 'none' end as pick_method from picks""",
    _SPELT,
))
def misspelt_outcomes(s, d):
    """What answers recommend when names one letter off count for brands that an answer nowhere spells right."""
    rows = an.spelt(t.answer_texts(s, d), REGISTRY)
    found = an.outcomes(rows, REGISTRY, RECOMMENDS, ALTERNATIVE, read="spelt")
    return found.select("record_id", "arm", F.array_join("named", ",").alias("named"), "first_named", "first_brand", F.length("spelt").cast("long").alias("chars"), "pick_method")


_NAMED = """shares as (select arm, brand, any_value(answers) as answers, cast(sum(m) as bigint) as mentions, cast(sum(p) as bigint) as picks from (
   select arm, unnest(named) as brand, 1 as m, 0 as p from outcome union all select arm, first_brand, 0, 1 from outcome where first_brand is not null) join (select arm, count(*) as answers from outcome group by 1) using (arm) group by 1, 2)"""


@query(texts_oracle("select *, round(mentions / cast(answers as double), 6) as mention_share, round(picks / cast(answers as double), 6) as pick_share from shares", _OUT, _NAMED))
def named_rates(s, d):
    return an.named_rates(_outcomes(s, d), "arm")


@query(texts_oracle(f"select arm, brand, picks, cast(rank as integer) as rank from (select *, row_number() over (partition by arm order by picks desc, brand) as rank from shares where brand <> '{TARGET}' and picks > 0) where rank <= 5", _OUT, _NAMED))
def picked_rivals_topk(s, d):
    return an.top_picked(an.named_rates(_outcomes(s, d), "arm"), "arm", TARGET)


_PRESENT = f"present as (select record_id, brand, min(position) as first_position, count(*) as n_results from (select distinct record_id, position, unnest(list_concat({names_sql('text')}, list_filter([" + ", ".join(f"case when contains(host, '{stem}') then '{b}' end" for b, stem in t.OWN.items()) + "], lambda b: b is not null))) as brand from result_texts) group by 1, 2)"


@query(texts_oracle("select * from present", _PRESENT))
def retrieval_presence(s, d):
    """Results that name a brand or lie on its own domain, per conversation and brand."""
    return an.retrieval_presence(t.result_texts(s, d), REGISTRY, t.OWN)


@query(texts_oracle(f"""select a.record_id, cast(coalesce(spot, 0) > 0 as bigint) as mentioned, cast(coalesce(spot, 0) = 1 as bigint) as first, nullif(coalesce(spot, 0), 0) as position, cast(p.brand is not null as bigint) as present, p.first_position as first_result, coalesce(p.n_results, 0) as n_results
  from (select conv_id as record_id, cast(list_position({distinct_sql('names')}, '{TARGET}') as bigint) as spot from (select conv_id, {names_sql('text')} as names from (select conv_id, string_agg(text, chr(10) order by turn) as text from conversations where role = 'assistant' group by 1))) a
  left join (select * from present where brand = '{TARGET}') p using (record_id)""", _PRESENT))
def answer_observations(s, d):
    """One row per conversation: what its answers, taken together, and its results say of the target."""
    rows = table(s, d, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    rows = rows.select("record_id", F.array_join(F.transform("turns", lambda x: x["text"]), "\n").alias("text"))
    return an.observations(rows, REGISTRY, an.retrieval_presence(t.result_texts(s, d), REGISTRY, t.OWN), TARGET)


CLAIM, WARNS = r"(?i)keit|tion", r"(?i)nicht|not|pas"


@query(texts_oracle(f"select arm, count(*) as answers, round(avg(e), 6) as echo_rate, round(avg(w) filter (where e = 1), 6) as warn_given_echo, round(avg(w), 6) as warn_rate from (select arm, cast(regexp_matches(text, '{CLAIM}') as integer) as e, cast(regexp_matches(text, '{WARNS}') as integer) as w from answer_texts) group by 1"))
def echo_rates(s, d):
    return an.echo(t.answer_texts(s, d), "arm", CLAIM, WARNS)


@query(texts_oracle(f"""select record_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as names from (select record_id, list_filter(list_concat({distinct_sql('names')}, ['Que', 'Added']), lambda x: x <> 'Erlich') as l from (select *, {names_sql('text')} as names from answer_texts))"""))
def edited_candidates(s, d):
    """Names of an answer with a user's corrections."""
    names = F.array_distinct(nm.names_in(F.col("text"), REGISTRY))
    fixed = an.edited(F.col("names"), F.array(F.lit("Que"), F.lit("Added")), F.array(F.lit("erlich")))
    return t.answer_texts(s, d).select("record_id", names.alias("names")).select("record_id", F.array_join(fixed, ",").alias("names"))


@query(texts_oracle(f"""select record_id, cast(spot - 1 as integer) as spot, array_to_string(words[greatest(spot - 9, 1):greatest(spot - 9, 1) + 17], ' ') as quote from (select record_id, words, list_position(list_transform(words, lambda x: {t.brand_sql('x')} is not null), true) as spot
  from (select record_id, regexp_extract_all(coalesce(text, ''), '{t.WORD}') as words from answer_texts)) where spot > 0"""))
def quote_windows(s, d):
    """The 18 words around the first name of an answer."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(t.WORD), F.lit(0))
    rows = t.answer_texts(s, d).select("record_id", words.alias("words"))
    spot = F.array_position(F.transform("words", lambda w: F.size(nm.names_in(w, REGISTRY)) > 0), F.lit(True)).cast("int") - 1
    rows = rows.withColumn("spot", spot).where("spot >= 0")
    return rows.select("record_id", "spot", nm.quote_window(F.lit(None), F.col("words"), F.col("spot")).alias("quote"))


THEMES = (("tests", r"(?i)tion .*tion "), ("prices", r"[0-9]"), ("users", r"(?i)keit"), ("makers", r"(?i)ment"), ("care", r"[ñÑ]"), ("lists", r"\n"))


@query("select doc_id, case " + " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{k}'" for k, p in THEMES) + " else 'other' end as theme from documents")
def source_themes(s, d):
    return table(s, d, "documents").select("doc_id", nm.first_theme(F.col("text"), THEMES).alias("theme"))


# ---- guards ---------------------------------------------------------------------------------------------------------
@query(f"""select conv_id, turn, length(trim(text)) between 1 and 120 and not regexp_matches(text, '[\\p{{Cc}}\\p{{Cf}}]') as fair, contains(regexp_replace(lower(translate(text, 'İ', 'i')), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), 'ing the') or contains(regexp_replace(lower(translate(text, 'İ', 'i')), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), 'die ') as choice,
  contains({t.TEXT_KEY_SQL.format('text')}, ' thtion ') as occurs, md5(case when not contains(r, '<think>') and not contains(r, '</think>') then regexp_replace(r, '^[ \\t\\n\\f\\r\\x0B]+|[ \\t\\n\\f\\r\\x0B]+$', '', 'g') end) as final from (select *, regexp_replace('<think>' || substr(text, 1, 9) || '</think>' || text, '(?s)<think>.*?</think>', '', 'g') as r from conversations)""")
def text_guards(s, d):
    """Guards of user texts and answers, over every whole turn."""
    text = F.col("text")
    thought = F.concat(F.lit("<think>"), F.substring(text, 1, 9), F.lit("</think>"), text)
    return table(s, d, "conversations").select("conv_id", "turn", nm.fair_input(text).alias("fair"), nm.asks_choice(text, ["ing the", "die "]).alias("choice"), nm.occurs(F.lit("thtion"), text).alias("occurs"), F.md5(nm.final_text(thought)).alias("final"))


KIND_RULES = (("affiliate", ("blog.",)), ("forum", ("m.th", "m.ti")), ("editorial", ("www.", "example.org")))
_HOST = "lower(split_part(regexp_replace(coalesce(url, ''), '^https?://', ''), '/', 1))"
_LABEL = "case when len(p) >= 2 then p[len(p) - 1] else p[1] end"


@query(f"""with h as (select page_id, url, {_HOST} as domain, string_split(regexp_replace(nullif(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1), ''), '^www\\.', ''), '.') as p from pages)
  select page_id, domain, case when contains({t.KEY_SQL.format('domain')}, 'tionsh') then 'official' {' '.join('when ' + ' or '.join(f"contains(domain, '{x}')" for x in parts) + f" then '{k}'" for k, parts in KIND_RULES)} else 'other' end as kind,
  regexp_matches(coalesce(url, ''), '^https?://[^/?#@\\s]+([/?#]|$)') as safe, coalesce(contains(array_to_string(p, '.'), 'tionsh'), false) as own, coalesce(regexp_matches('.' || array_to_string(p, '.'), '[.](example[.]net|blog[.]example[.]com)$'), false) as platform,
  coalesce({_LABEL} = 'example', false) as labelled from h""")
def url_guards(s, d):
    """Kind by parts of the domain, safe links, own sites, platforms and labels of every page."""
    url = F.col("url")
    domain, bare = ur.domain(url), ur.bare_host(url)
    own = F.coalesce(F.contains(bare, F.lit("tionsh")), F.lit(False))
    return table(s, d, "pages").select(
        "page_id", domain.alias("domain"), ur.kind_by_parts(domain, ["tionsh"], KIND_RULES).alias("kind"), ur.safe(url).alias("safe"), own.alias("own"),
        F.coalesce(ur.on_platform(bare, ["example.net", "blog.example.com"]), F.lit(False)).alias("platform"), F.coalesce(nm.names_match_label(F.lit("Example"), ur.host_label(url)), F.lit(False)).alias("labelled"),
    )


# ---- audit ----------------------------------------------------------------------------------------------------------
#: Rules that bite in the given texts; the ones of the package are tested on real sentences.
RULES = (("technical", r"keit([^\p{L}]|$)"), ("price", r"[0-9]"), ("statistics", r"tion([^\p{L}]|$)"), ("authority", r"ment([^\p{L}]|$)"), ("superlative", r"(^|[^\p{L}])the([^\p{L}]|$)"))
CLAIMS = au.Claims(institution=r"heit([^\p{L}]|$)", proof=r"ung([^\p{L}]|$)", absolute=r"ñ")
_HAS = {k: f"regexp_matches(x, '{getattr(CLAIMS, k)}')" for k in ("institution", "proof", "absolute")}
_TYPES = f"case when ({_HAS['institution']} and ({_HAS['proof']} or {_HAS['absolute']})) or ({_HAS['proof']} and {_HAS['absolute']}) then ['fabricated_claim'] else list_filter([" + ", ".join(f"case when regexp_matches(x, '{p}') then '{k}' end" for k, p in RULES) + "], lambda k: k is not null) end"
_SENTENCES = f"""sentences as (select record_id, arm, spot, sentence, {_TYPES} as types from (select record_id, arm, sentence, spot, lower(translate(sentence, 'İ', 'i')) as x from (select record_id, arm, unnest(l) as sentence, cast(generate_subscripts(l, 1) - 1 as integer) as spot from (select record_id, arm,
  list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\n\\f\\r\\x0B]+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as l from answer_texts)))),
 found as (select record_id, any_value(arm) as arm, type, count(*) as n from (select record_id, arm, unnest(types) as type from sentences) group by record_id, type)"""


@query(texts_oracle("select record_id, type, n, n_rivals from (select *, count(*) over (partition by arm, type) - 1 as n_rivals from found)", _SENTENCES))
def sentence_audit(s, d):
    """How many sentences of each type an answer has, and how many other answers of its arm have the type."""
    rows = t.answer_texts(s, d)
    found = au.audit(rows, "record_id", "text", RULES, CLAIMS).join(rows.select("record_id", "arm"), "record_id")
    return au.with_rivals(found, "record_id", "arm").select("record_id", "type", "n", "n_rivals")


_VERDICT = "verdict as (select type, x, y, case when x >= 0.3 and y >= 0.3 then 'strong' when x >= 0.3 or y >= 0.3 then 'mixed' else 'weak' end as verdict from (select type, round(a / 60.0, 6) as x, round(b / 60.0, 6) as y from (values " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in tx.WINS.items()) + ") v(type, a, b)))"


@query(texts_oracle("""select record_id, type, case when n_rivals is not null and verdict = 'weak' then 'replace' when n_rivals is not null and verdict = 'mixed' then 'mixed' when n_rivals = 0 then 'differentiate' when n_rivals is not null then 'keep' else 'add' end as action
  from (select distinct record_id from answer_texts) cross join verdict left join (select *, count(*) over (partition by arm, type) - 1 as n_rivals from found) using (record_id, type) where n_rivals is not null or verdict = 'strong'
  union all select record_id, type, 'risk' from found where type = 'fabricated_claim' union all select record_id, null, 'empty' from (select distinct record_id from answer_texts) where record_id not in (select record_id from found)""", _SENTENCES, _VERDICT))
def audit_advice(s, d):
    """What to do about each sentence type in each answer, from win shares."""
    rows = t.answer_texts(s, d)
    found = au.audit(rows, "record_id", "text", RULES, CLAIMS).join(rows.select("record_id", "arm"), "record_id")
    return au.advice(au.with_rivals(found, "record_id", "arm"), tx.verdicts(s), rows, "record_id")


_ORDER = "case action " + " ".join(f"when '{a}' then {v[0]}" for a, v in au.ACTIONS.items()) + " end"
_TEXT = "case action " + " ".join(f"when '{a}' then '" + v[1].replace("'", "''") + "'" for a, v in au.ACTIONS.items()) + " end"


@query(texts_oracle(
    f"""select record_id, type, action, cast(row_number() over (partition by record_id order by {_ORDER}, coalesce(list_position([{', '.join(repr(k) for k, _ in au.TYPES)}], type), 0), type) as integer) as place,
      replace({_TEXT}, '{{}}', replace(coalesce(type, ''), '_', ' ')) as text from actions""",
    _SENTENCES, _VERDICT, """actions as (
  select record_id, type, case when n_rivals is not null and verdict = 'weak' then 'replace' when n_rivals is not null and verdict = 'mixed' then 'mixed' when n_rivals = 0 then 'differentiate' when n_rivals is not null then 'keep' else 'add' end as action
  from (select distinct record_id from answer_texts) cross join verdict left join (select *, count(*) over (partition by arm, type) - 1 as n_rivals from found) using (record_id, type) where n_rivals is not null or verdict = 'strong'
  union all select record_id, type, 'risk' from found where type = 'fabricated_claim' union all select record_id, null, 'empty' from (select distinct record_id from answer_texts) where record_id not in (select record_id from found))""",
))
def ordered_advice(s, d):
    """The advice on every answer as text, in the order in which it is given."""
    return au.advice_texts(audit_advice(s, d), "record_id")


_CLAIMED = "claimed as (select record_id, sentence, case when spot % 2 = 0 then 'price' else 'made_up' end as type from sentences)"


@query(texts_oracle("""select record_id, spot, array_to_string(list_sort(list(distinct type)), ',') as types from (select s.record_id, s.spot, c.type from sentences s join (select * from claimed where type = 'price') c on s.record_id = c.record_id and (contains(s.sentence, c.sentence) or contains(c.sentence, s.sentence))) group by 1, 2""", _SENTENCES, _CLAIMED))
def marked_sentences(s, d):
    """Sentences of an answer that a classification (known types, verbatim quotes) marks."""
    rows = t.answer_texts(s, d)
    each = au.typed_sentences(rows, "record_id", "text", RULES, CLAIMS)
    claimed = each.select("record_id", "sentence", F.when(F.col("spot") % 2 == 0, "price").otherwise("made_up").alias("type"))
    kept = au.verbatim(claimed, rows, "record_id", "text", [k for k, _ in RULES])
    return au.marked(each, kept, "record_id").select("record_id", "spot", F.array_join("types", ",").alias("types"))


SCREEN = (("reviews", r"keit .{0,9}die"), ("ranking", r"tion .{0,12}(the|and)\b"), ("spam", r"la .{0,9}que"))


@query("select conv_id, turn, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(translate(coalesce(text, ''), 'İ', 'i')), '{p}') then '{k}' end" for k, p in SCREEN) + "], lambda k: k is not null), ',') as rules from conversations")
def ethics_rules(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(au.broken_rules(F.col("text"), SCREEN), ",").alias("rules"))


@query(texts_oracle("select type, x as first_share, y as second_share, verdict, cast(n as bigint) as sentences from verdict join (select type, sum(n) as n from found group by 1) using (type)", _SENTENCES, _VERDICT))
def type_verdicts(s, d):
    """Win shares and verdict of every sentence type that the answers use."""
    used = au.audit(t.answer_texts(s, d), "record_id", "text", RULES, CLAIMS).groupBy("type").agg(F.sum("n").alias("sentences"))
    return tx.verdicts(s).join(used, "type")


# ---- what models reply ----------------------------------------------------------------------------------------------
@query(texts_oracle(
    """select record_id, case when brand <> '' and sector <> '' then brand end as brand, case when brand <> '' and sector <> '' then sector end as sector,
      case when brand <> '' and sector <> '' then case when lower(w[3]) <> lower(brand) and w[3] <> '' then w[3] else '' end end as alias, case when brand <> '' and sector <> '' then s end as sentence,
      case when brand = '' or sector = '' then 'no brand or sector' end as fault
    from (select record_id, w, coalesce(w[1], '') as brand, coalesce(w[2], '') as sector, trim(substr(text, 1, 20)) as s from (select record_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\\p{L}]+') as w from answer_texts))""",
))
def reply_profiles(s, d):
    """Profiles out of replies that are made of an answer's own words, with an invented alias and sentence in each."""
    rows = t.answer_texts(s, d).select("record_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)))
    word = lambda i: F.get("w", F.lit(i))
    product = F.struct(F.lit("p").alias("name"), F.lit("c").alias("category"), F.array(F.lit("made up of nothing"), F.substring("text", 1, 20)).alias("sentences"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(word(0).alias("brand"), word(1).alias("sector"), F.array(F.lit("zzz zzz"), word(2)).alias("aliases"), F.array(product).alias("products"))), F.lit("\n```"))
    found = rp.parse_profile(rows.select("record_id", "text", reply.alias("reply")), "reply", "text")
    alias = F.when(F.col("aliases").isNotNull(), F.coalesce(F.get("aliases", F.lit(0)), F.lit("")))
    return found.select("record_id", "brand", "sector", alias.alias("alias"), F.get(F.get("products", F.lit(0))["sentences"], F.lit(0)).alias("sentence"), "fault")
