"""The registered analytics queries, each with the DuckDB text that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.functions import text as tx
from lexigauge.functions import urls as ur
from lexigauge.operators import concentration as co
from lexigauge.operators import effects as ef
from lexigauge.operators import integrity as it
from lexigauge.operators import metrics as me
from lexigauge.operators import panel as pa
from lexigauge.operators import profile as pr
from lexigauge.operators import rates as ra
from lexigauge.operators.ordering import reused
from lexigauge.plans import design as de
from lexigauge.plans.registry import ORACLES, QUERIES, query
from lexigauge.sources import corpus as c
from lexigauge.sources.corpus import oracle

# ---- rates ----------------------------------------------------------------------------------------------------------
RATES = """rates as (
  select category, condition, brand, cast(coalesce(n, 0) as bigint) as wins, denominator, round(cast(coalesce(n, 0) as double) / denominator, 6) as rate
  from (select category, condition, count(*) as denominator from answers group by 1, 2) cross join registry
  left join (select category, condition, top as brand, count(*) as n from answers where top is not null group by 1, 2, 3) using (category, condition, brand))"""
VOICE = """voice as (
  select category, condition, brand, count(*) as mentions, cast(sum(case when top = brand then 1 else 0 end) as bigint) as wins, any_value(total) as total,
         round(cast(count(*) as double) / any_value(total), 6) as mention_share,
         round(cast(sum(case when top = brand then 1 else 0 end) as double) / any_value(total), 6) as win_share
  from answers join mentions using (record_id) join (select category, condition, count(*) as total from answers group by 1, 2) using (category, condition)
  group by category, condition, brand)"""


def _rates(s: SparkSession, d: str) -> DataFrame:
    return ra.recommendation_rates(c.answers(s, d), c.registry(s, d))


def _voice(s: SparkSession, d: str) -> DataFrame:
    return ra.share_of_voice(c.answers(s, d), c.mentions(c.results(s, d)))


@query(oracle("select * from rates", RATES))
def rec_rate_segment(s, d):
    return _rates(s, d)


@query(oracle("select category, brand, round((sum(case when condition = 'search_on' then rate end) - sum(case when condition = 'search_off' then rate end)) * 100, 4) as points from rates group by 1, 2", RATES))
def rec_rate_pp_change(s, d):
    return ra.rate_change(_rates(s, d))


FINDINGS = [("AUTOMOBILE", "search_off", "Brand#1"), ("BUILDING", "search_on", "Brand#2"), ("FURNITURE", "search_off", "Brand#3"), ("HOUSEHOLD", "search_on", "Brand#4"), ("MACHINERY", "search_off", "Brand#5")]


@query(oracle(f"select category, condition, brand, wins as count, denominator, round(rate * 100, 4) as rate_percent from rates where (category, condition, brand) in ({', '.join(map(str, FINDINGS))})", RATES))
def five_findings(s, d):
    return ra.findings(_rates(s, d), s.createDataFrame(FINDINGS, "category string, condition string, brand string"))


@query(oracle("select count(*) as rows, count(distinct record_id) as records, count(*) - count(distinct record_id) as repeated, count(*) - count(top) as undecided, count(distinct query_id) as queries from answers"))
def quality_summary(s, d):
    return ra.quality_summary(c.answers(s, d))


@query(oracle("select query_id, model_id, condition, count(*) as n from responses group by 1, 2, 3 having count(*) < 30"))
def incomplete_cells(s, d):
    return ra.incomplete_cells(c.responses(s, d), 30)


@query(oracle("""select query_id, model_id, condition, 'missing' as side from (
  select q.query_id, m.model_id, k.condition
  from (select distinct query_id from monthly) q cross join (select distinct model_id from monthly) m cross join (select distinct condition from monthly) k
  except select query_id, model_id, condition from monthly)""",
    "monthly as (select model_id, condition, concat(query_id, '_', strftime(cast(asked as date), '%Y-%m')) as query_id from responses)"))
def contract_expected_vs_actual(s, d):
    """Every query of every month, asked of every model under every condition: the cells that the answers lack."""
    monthly = c.responses(s, d).withColumn("query_id", F.concat_ws("_", "query_id", F.date_format("asked", "yyyy-MM")))
    return ra.contract(monthly, ra.expected_cells(monthly))


@query(oracle("""select case when grouping(category) = 0 then 'category' when grouping(query_id) = 0 then 'query_id' when grouping(model_id) = 0 then 'model_id' when grouping(condition) = 0 then 'condition' when grouping(confidence) = 0 then 'confidence' else 'all' end as dimension,
  coalesce(category, query_id, model_id, condition, confidence, 'ALL') as value, count(*) as n from responses group by grouping sets ((category), (query_id), (model_id), (condition), (confidence), ())"""))
def plan_grouping_sets(s, d):
    return ra.plan_summary(c.responses(s, d))


@query(oracle("select * from voice", VOICE))
def asov_long(s, d):
    return _voice(s, d)


@query(oracle("""select category, brand, "off", "on", round("on" - "off", 6) as change from (select category, brand, coalesce(sum(case when condition = 'search_off' then mention_share end), 0) as "off", coalesce(sum(case when condition = 'search_on' then mention_share end), 0) as "on" from voice group by 1, 2)""", VOICE))
def asov_change(s, d):
    return ra.share_change(_voice(s, d))


@query(oracle("""select condition, model_id, count(*) as responses, cast(sum(case when m.brand is null then 0 else 1 end) as bigint) as mentions, cast(sum(case when top = 'Brand#7' then 1 else 0 end) as bigint) as wins,
  round(cast(sum(case when m.brand is null then 0 else 1 end) as double) / count(*), 6) as mention_rate, round(cast(sum(case when top = 'Brand#7' then 1 else 0 end) as double) / count(*), 6) as win_rate
  from answers a left join (select * from mentions where brand = 'Brand#7') m using (record_id) group by 1, 2"""))
def visibility_model_condition(s, d):
    return ra.visibility(c.answers(s, d), c.mentions(c.results(s, d)), "Brand#7")


@query(oracle("""select * from (select category, top as brand, count(*) as picks, cast(row_number() over (partition by category order by count(*) desc, top) as integer) as rank from answers where top is not null group by 1, 2) where rank <= 10"""))
def top_recommendations_topk(s, d):
    return ra.top_recommendations(c.answers(s, d))


# ---- evidence and panel ---------------------------------------------------------------------------------------------
EVIDENCE = """evidence as (select substr(sha256(concat_ws('|', cast(record_id as varchar), cast(position as varchar), brand, host)), 1, 24) as source_id, record_id, category, query_id, position, brand, kind, host
  from results join (select record_id, category, query_id from responses where condition = 'search_on') using (record_id))"""


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return pa.evidence(c.responses(s, d), c.results(s, d))


@query(oracle("select * from results"))
def sources_exploded(s, d):
    return c.results(s, d)


@query(oracle("select * from evidence", EVIDENCE))
def evidence_rows(s, d):
    return _evidence(s, d)


@query(oracle("select * from pairs"))
def pairs_panel(s, d):
    return c.pairs(s, d)


@query(oracle("select brand from mentions intersect select brand from registry"))
def universe_intersect(s, d):
    return pa.universe(c.mentions(c.results(s, d)), c.registry(s, d))


@query(oracle("select record_id, brand, cast(case when best_position = 0 then 99 else best_position end as bigint) as best_position, cast(case when best_position = 0 then 1 else 0 end as bigint) as best_position_missing from pairs"))
def finalise_positions(s, d):
    return c.finalise(c.pairs(s, d)).select("record_id", "brand", "best_position", "best_position_missing")


def _prior_sql(by: str, label: str, only: str) -> str:
    return oracle(f"""select {by}, brand, round((h + 10 * base) / (n + 10), 6) as prior from (select {by}, brand, sum({label}) as h, count(*) as n from pairs where {only} group by {by}, brand)
      join (select {by}, avg(cast({label} as double)) as base from pairs where {only} group by {by}) using ({by})""")


@query(_prior_sql("category", "y_top", "response_decided = 1 and condition = 'search_off'"))
def priors_global(s, d):
    return pa.priors(c.pairs(s, d), ["category"], "y_top", "response_decided = 1 and condition = 'search_off'")


@query(_prior_sql("category, model_id", "y_mention", "true"))
def priors_model(s, d):
    return pa.priors(c.pairs(s, d), ["category", "model_id"], "y_mention")


FOLDS = "folds as (select category, query_id, cast((row_number() over (partition by category order by md5(query_id), query_id) - 1) % 5 as integer) as fold from (select distinct category, query_id from responses))"


@query(oracle("select * from folds", FOLDS))
def folds_mod(s, d):
    return pa.folds(c.responses(s, d))


@query(oracle("select query_id, count(distinct record_id % 2) as n_folds from responses group by 1 having count(distinct record_id % 2) > 1"))
def fold_leaks(s, d):
    return pa.fold_leaks(c.responses(s, d).withColumn("fold", F.col("record_id") % 2))


@query(oracle("""select o, i, category, brand, round((h + 10 * base) / (n + 10), 6) as prior from used join (select o, i, category, cast(sum(h) as double) / sum(n) as base from used group by 1, 2, 3) using (o, i, category)""".replace("select o, i, category, brand,", "select o as outer_fold, i as inner_fold, category, brand,"), FOLDS,
    """per as (select fold, category, brand, sum(y_top) as h, count(*) as n from pairs join (select query_id, fold from folds) using (query_id) where response_decided = 1 group by 1, 2, 3)""",
    """used as (select o.f as o, i.f as i, category, brand, sum(h) as h, sum(n) as n from per cross join (select distinct fold as f from folds) o cross join (select distinct fold as f from folds) i where fold <> o.f and fold <> i.f group by 1, 2, 3, 4)"""))
def priors_cross_fitted(s, d):
    return pa.cross_fitted(c.pairs(s, d), pa.folds(c.responses(s, d)))


FILTERED = "kept as (select * from scored where condition = 'search_on' and confidence <> 'low' and response_decided = 1)"


def _kept(s: SparkSession, d: str) -> DataFrame:
    return c.scored(pa.panel_filter(c.pairs(s, d)))


def _few(s: SparkSession, d: str) -> DataFrame:
    """``_kept`` with an answer's unseen candidates as one row of weight m: they tie at 0, below every seen one, and never win."""
    return c.scored(pa.panel_filter(c.folded(s, d)))


@query(oracle("select category, model_id, count(*) as n, count(distinct record_id) as answers from kept group by 1, 2", FILTERED))
def panel_filter(s, d):
    return pa.panel_filter(c.pairs(s, d)).groupBy("category", "model_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("answers"))


_KIND_SHARES = ", ".join(f"round(n_{k} / cast(greatest(n_results_mentioning, 1) as double), 6) as share_{k}" for k in c.KINDS)


@query(oracle(f"""select record_id, brand, y_top, round(coalesce(n_results_mentioning / nullif(cast(n_results as double), 0), 0), 6) as volume_share,
  round(coalesce(n_results_mentioning / nullif(cast(max(n_results_mentioning) over (partition by record_id) as double), 0), 0), 6) as volume_vs_leader,
  round((rank() over (partition by record_id order by n_results_mentioning) + (count(*) over (partition by record_id, n_results_mentioning) - 1) / 2.0e0) / count(*) over (partition by record_id), 6) as volume_rank_pct,
  cast(case when in_search_results = 1 and best_position = min(case when in_search_results = 1 then best_position end) over (partition by record_id) then 1 else 0 end as bigint) as is_top_retrieved,
  round(case when in_search_results = 1 then (rank() over (partition by record_id, in_search_results order by -best_position) + (count(*) over (partition by record_id, in_search_results, best_position) - 1) / 2.0e0) / count(*) over (partition by record_id, in_search_results) else 0 end, 6) as position_rank_pct,
  {_KIND_SHARES} from kept left join (select record_id, count(*) as n_results from results group by 1) using (record_id)""", FILTERED))
def relative_features(s, d):
    return pa.relative(pa.panel_filter(c.pairs(s, d, sizes=True)))


@query(oracle("select record_id, brand, y_top from (select *, row_number() over (partition by record_id, y_top order by md5(concat_ws('|', cast(record_id as varchar), brand)), brand) as rn from kept) where y_top = 1 or rn <= 7", FILTERED))
def negative_sample(s, d):
    return pa.negatives(pa.panel_filter(c.pairs(s, d)))


# ---- profiles -------------------------------------------------------------------------------------------------------
BOARD = """board as (select *, cast(rank() over (partition by category order by mention_on desc) as integer) as rank_on from (
  select category, brand, round(avg(case when condition = 'search_off' then cast(y_mention as double) end), 6) as mention_off, round(avg(case when condition = 'search_on' then cast(y_mention as double) end), 6) as mention_on, round(avg(case when condition = 'search_on' then cast(y_top as double) end), 6) as top_on from pairs group by 1, 2))"""
_SHARES = ", ".join(f"round(cast(sum(n_{k}) as double) / greatest(sum(n_results_mentioning), 1), 6) as share_{k}" for k in c.KINDS)
PROFILE = f"""profile as (select category, brand, round(avg(cast(in_search_results as double)), 6) as presence, round(avg(cast(n_results_mentioning as double)), 6) as results_per_answer, round(avg(case when best_position = 1 then 1.0e0 else 0.0e0 end), 6) as rank1_share, {_SHARES}
  from pairs where condition = 'search_on' group by 1, 2)"""
LEADERS = "leaders as (select category, brand, cast(place as integer) as place from (select *, row_number() over (partition by category order by mention_on desc, top_on desc, brand) as place from board) where place <= 3)"


@query(oracle("select * from board", BOARD))
def leaderboard(s, d):
    return pr.leaderboard(c.pairs(s, d))


@query(oracle("select * from leaders", BOARD, LEADERS))
def winners_topk(s, d):
    return pr.leaders(pr.leaderboard(c.pairs(s, d)))


@query(oracle("select * from profile", PROFILE))
def retrieval_profile(s, d):
    return pr.retrieval_profile(c.pairs(s, d))


_LONG = " union all ".join(f"select category, brand, '{m}' as metric, {m} as value from both_" for m in ("presence", "results_per_answer", "rank1_share", "share_editorial", "share_affiliate", "share_forum", "mention_on", "top_on"))


@query(oracle("""select l.category, l.brand, l.metric, any_value(l.value) as mine, round(avg(t.value), 6) as winners, round(any_value(l.value) - round(avg(t.value), 6), 6) as gap
  from long l join (select long.* from long join leaders using (category, brand)) t on l.category = t.category and l.metric = t.metric and l.brand <> t.brand group by 1, 2, 3""", BOARD, PROFILE, LEADERS, "both_ as (select p.*, mention_on, top_on from profile p join board using (category, brand))", f"long as ({_LONG})"))
def gaps(s, d):
    evidence = ["y_mention", "y_top", "in_search_results", "n_results_mentioning", "best_position", *[f"n_{k}" for k in c.KINDS]]
    panel = reused(pa.tallied(c.folded(s, d), c.registry(s, d), ["category", "condition"], evidence))
    board = reused(pr.leaderboard(panel, "m"))
    return pr.gaps(reused(pr.retrieval_profile(panel, "m")), board, pr.leaders(board))


@query(oracle("select * from (select category, brand, host, kind, count(distinct record_id) as answers, min(position) as best, cast(row_number() over (partition by category, brand order by count(distinct record_id) desc, host, kind) as integer) as rank from evidence group by 1, 2, 3, 4) where rank <= 12", EVIDENCE))
def brand_sources_topk(s, d):
    return pr.brand_sources(_evidence(s, d))


@query(oracle("""select n.category, b.brand, n.host, n.named from (select category, host, count(distinct brand) as named from evidence where kind in ('editorial', 'forum', 'affiliate') group by 1, 2 having count(distinct brand) >= 2) n
  join (select distinct category, brand from evidence) b on n.category = b.category where not exists (select 1 from evidence e where e.category = n.category and e.host = n.host and e.brand = b.brand)""", EVIDENCE))
def outreach_targets(s, d):
    return pr.outreach(_evidence(s, d))


@query(oracle("""select category, brand, relevance, presence from (select *, row_number() over (partition by category order by presence, brand) as rn from (
  select category, brand, round(avg(case when condition = 'search_off' then cast(y_mention as double) end), 6) as relevance, round(avg(case when condition = 'search_on' then cast(in_search_results as double) end), 6) as presence from pairs group by 1, 2) where relevance between 0.05 and 0.40) where rn <= 2"""))
def target_selection(s, d):
    return pr.targets(c.pairs(s, d))


@query(oracle("select category, brand, cast(place as integer) as place from (select *, row_number() over (partition by category order by mention_on desc, top_on desc, brand) as place from board) where place <= 2", BOARD))
def peer_selection(s, d):
    return pr.leaders(pr.leaderboard(c.pairs(s, d)), 2)


@query(oracle("""select query_id, record_id, n_results from (select query_id, record_id, n_results, row_number() over (partition by query_id order by n_results, record_id) as rn, count(*) over (partition by query_id) as n
  from responses join (select record_id, count(*) as n_results from results group by 1) using (record_id) where condition = 'search_on') where rn = (n - 1) // 2 + 1"""))
def context_lower_median(s, d):
    return pr.contexts(c.responses(s, d), c.results(s, d).groupBy("record_id").agg(F.count(F.lit(1)).alias("n_results")))


OBSERVED = """observed as (select category, brand, round(avg(case when condition = 'search_off' then cast(y_mention as double) end), 6) as mention_off, round(avg(case when condition = 'search_on' then cast(y_mention as double) end), 6) as mention_on,
  round(avg(case when condition = 'search_on' then cast(y_top as double) end), 6) as first_on, round(avg(case when condition = 'search_on' then cast(in_search_results as double) end), 6) as presence, count(distinct query_id) as queries,
  list_extract(list_sort(list(best_position) filter (where condition = 'search_on' and best_position > 0)), cast(count(*) filter (where condition = 'search_on' and best_position > 0) // 2 + 1 as integer)) as median_position from pairs group by 1, 2)"""


@query(oracle("select * from observed", OBSERVED))
def observation_rates(s, d):
    return pr.observation_rates(c.pairs(s, d))


FAMILIES = """families as (select record_id, category, query_id, condition, substr(brand, 1, 7) as brand, max(y_mention) as y_mention, max(y_top) as y_top, max(in_search_results) as in_search_results, coalesce(min(case when best_position > 0 then best_position end), 0) as best_position from pairs group by 1, 2, 3, 4, 5)"""


@query(oracle("""select category, brand, presence, median_position, mention_on, first_on, case when queries < 3 then 'thin' when presence < 0.34 then 'absent' when median_position > 5 then 'low_rank' when first_on >= 0.20 then 'leader'
  when mention_on >= 0.30 and first_on = 0 then 'ceiling' else 'low_rank' end as diagnosis from observed""", FAMILIES, OBSERVED.replace("from pairs", "from families")))
def diagnose(s, d):
    """Families of brands (those that begin alike): large ones lead, small ones are absent."""
    first = F.min(F.when(F.col("best_position") > 0, F.col("best_position")))
    rows = c.folded(s, d).groupBy("record_id", "category", "query_id", "condition", F.substring("brand", 1, 7).alias("brand"))
    family = rows.agg(*[F.max(x).alias(x) for x in ("y_mention", "y_top", "in_search_results")], F.coalesce(first, F.lit(0).cast("long")).alias("best_position"))
    families = c.registry(s, d).select(F.substring("brand", 1, 7).alias("brand"))
    panel = pa.tallied(family, families, ["category", "query_id", "condition"], ["y_mention", "y_top", "in_search_results", "best_position"])
    return pr.diagnose(pr.observation_rates(panel, "m"))


@query(oracle("""select * from (select category, a.brand, b.brand as rival, count(*) as n, cast(row_number() over (partition by category, a.brand order by count(*) desc, b.brand) as integer) as rank
  from (select record_id, category, brand from pairs where condition = 'search_on' and y_mention = 1) a join (select record_id, brand from pairs where condition = 'search_on' and y_mention = 1) b on a.record_id = b.record_id and a.brand <> b.brand group by 1, 2, 3) where rank <= 5"""))
def rival_brands(s, d):
    return pr.rivals(c.pairs(s, d))


@query(oracle("""select category, brand, metric, mine, theirs from (select *, round((sum(mine) over (partition by category, metric) - mine) / (count(*) over (partition by category, metric) - 1), 6) as theirs from (
  select category, brand, 'presence' as metric, presence as mine from profile union all select category, brand, 'results_per_answer', results_per_answer from profile union all select category, brand, 'rank1_share', rank1_share from profile)) where mine < 0.75 * theirs""", PROFILE))
def lagging_signals(s, d):
    return pr.lagging(pr.retrieval_profile(c.pairs(s, d)))


# ---- metrics --------------------------------------------------------------------------------------------------------
AP = """ap as (select category, case when max(p) > 0 and max(p) < max(seen) then round(sum(hits * tp / cast(seen as double)) / max(p), 6) end as average_precision from (
  select category, hits, sum(hits) over w as tp, sum(n) over w as seen, sum(hits) over (partition by category) as p from (select category, score, sum(y_top) as hits, count(*) as n from kept group by 1, 2) window w as (partition by category order by score desc)) group by 1)"""
ROC = """roc as (select category, round((sum(p * (below + (n + 1) / 2.0e0)) - sum(p) * (sum(p) + 1) / 2.0e0) / (cast(sum(p) as double) * (sum(n) - sum(p))), 6) as roc_auc from (
  select category, p, n, sum(n) over (partition by category order by score) - n as below from (select category, score, sum(y_top) as p, count(*) as n from kept group by 1, 2)) group by 1)"""
BRIER = "brier as (select category, round(avg((least(greatest(score, 0), 1) - y_top) * (least(greatest(score, 0), 1) - y_top)), 6) as brier from kept group by 1)"
RANKED = "ranked as (select *, row_number() over (partition by record_id order by score desc, brand) as place, sum(y_top) over (partition by record_id) as positives from kept)"
TOP1 = """top1 as (select category, count(*) filter (where positives = 1) as usable, case when 2 * count(*) filter (where positives = 1) >= count(*) then round(cast(count(*) filter (where positives = 1 and y_top = 1) as double) / count(*) filter (where positives = 1), 6) end as top1 from ranked where place = 1 group by 1)"""
GAIN = """gain as (select category, query_id, record_id, sum(y_top / log2(place + 1.0e0)) / max(1 + case when positives >= 2 then 1 / log2(3.0e0) else 0 end + case when positives >= 3 then 1 / log2(4.0e0) else 0 end) as ndcg from ranked where positives > 0 and place <= 3 group by 1, 2, 3)"""
NDCG = "ndcg as (select category, round(avg(ndcg), 6) as ndcg from gain group by 1)"


@query(oracle("select * from ap", FILTERED, AP))
def average_precision(s, d):
    return me.average_precision(_kept(s, d))


@query(oracle("select * from roc", FILTERED, ROC))
def roc_auc(s, d):
    return me.roc_auc(_kept(s, d))


@query(oracle("select * from brier", FILTERED, BRIER))
def brier(s, d):
    return me.brier(_kept(s, d))


@query(oracle("select * from top1", FILTERED, RANKED, TOP1))
def top1(s, d):
    return me.top1(_kept(s, d))


@query(oracle("select * from ndcg", FILTERED, RANKED, GAIN, NDCG))
def ndcg3(s, d):
    return me.ndcg(_kept(s, d))


@query(oracle("""select category, pairs, answers, average_precision, roc_auc, brier, top1, ndcg from (select category, count(*) as pairs, count(distinct record_id) as answers from kept group by 1)
  join ap using (category) join roc using (category) join brier using (category) join top1 using (category) join ndcg using (category)""", FILTERED, AP, ROC, BRIER, RANKED, TOP1, GAIN, NDCG))
def metric_summary_by_category(s, d):
    return me.summary(_kept(s, d))


@query(oracle(TOP1.split(" as (", 1)[1][:-1].replace("from ranked", "from noisy"), FILTERED, "noisy as (select *, row_number() over (partition by record_id order by score + cast('0x' || substr(md5(concat_ws('|', cast(record_id as varchar), brand)), 1, 8) as bigint) * 1e-19 desc, brand) as place, sum(y_top) over (partition by record_id) as positives from kept)"))
def tie_break_top1(s, d):
    return me.top1(_kept(s, d), noise=True)


@query(oracle("select category, round(avg(pct), 6) as winner_rank_pct from (select category, y_top, (rank() over (partition by record_id order by score) + (count(*) over (partition by record_id, score) - 1) / 2.0e0) / count(*) over (partition by record_id) as pct from kept) where y_top = 1 group by 1", FILTERED))
def winner_rank_share(s, d):
    return me.rank_share(_few(s, d), "m")


@query(oracle("select a.category, round(a.ndcg - b.ndcg, 6) as delta from ndcg a join (select category, round(avg(ndcg), 6) as ndcg from gain2 group by 1) b using (category)", FILTERED, RANKED, GAIN, NDCG,
    "ranked2 as (select *, row_number() over (partition by record_id order by n_results_mentioning desc, brand) as place, sum(y_top) over (partition by record_id) as positives from kept)", GAIN.replace("gain as", "gain2 as").replace("from ranked", "from ranked2")))
def paired_delta_point(s, d):
    rows = _few(s, d)
    other = rows.withColumn("score", F.col("n_results_mentioning").cast("double"))
    return ef.paired_delta(me.ndcg(rows), me.ndcg(other), "ndcg")


# ---- concentration --------------------------------------------------------------------------------------------------
CONC = """conc as (select category, condition, model_id, round(1 / hhi, 6) as effective_brands, case when brands >= 2 then round((hhi - 1.0e0 / brands) / (1 - 1.0e0 / brands), 6) end as normalised_hhi, round(topk, 6) as top_share, events, brands, never_named from (
  select category, condition, model_id, sum(s * s) as hhi, sum(case when rn <= 3 then s end) as topk, cast(sum(e) as bigint) as events, count(*) as brands, count(*) filter (where e = 0) as never_named from (
    select *, round(e / nullif(cast(sum(e) over (partition by category, condition, model_id) as double), 0), 12) as s, row_number() over (partition by category, condition, model_id order by e desc, brand) as rn from (
      select category, condition, coalesce(model_id, 'ALL') as model_id, brand, sum(y_mention) as e from pairs group by grouping sets ((category, condition, model_id, brand), (category, condition, brand)))) group by 1, 2, 3))"""
GAINS = "gains as (select category, brand, query_id, coalesce(avg(case when condition = 'search_on' then cast(y_mention as double) end), 0) as on_, coalesce(avg(case when condition <> 'search_on' then cast(y_mention as double) end), 0) as off_ from pairs group by 1, 2, 3)"
BGAINS = 'bgains as (select category, brand, round(avg(on_), 6) as "on", round(avg(off_), 6) as "off", round(avg(on_ - off_), 6) as gain from gains group by 1, 2)'
TERC = """terc as (select category, brand, case when 3 * rn <= n then 'low' when 3 * rn <= 2 * n then 'middle' else 'high' end as "group" from (select category, brand, row_number() over (partition by category order by "off", brand) as rn, count(*) over (partition by category) as n from bgains))"""


@query(oracle("select * from conc", CONC))
def concentration_cube(s, d):
    return co.concentration(c.pairs(s, d))


@query(oracle("select category, model_id, round(sum(case when condition = 'search_on' then effective_brands end) - sum(case when condition = 'search_off' then effective_brands end), 6) as change from conc group by 1, 2", CONC))
def retrieval_effect(s, d):
    return co.retrieval_effect(co.concentration(c.pairs(s, d)))


@query(oracle("select * from bgains", GAINS, BGAINS))
def brand_gains(s, d):
    return co.brand_gains(co.query_gains(c.pairs(s, d)))


@query(oracle("select * from terc", GAINS, BGAINS, TERC))
def recognition_terciles(s, d):
    return co.terciles(co.brand_gains(co.query_gains(c.pairs(s, d))))


_ORIGIN = "case cast(substr(brand, 7) as integer) % 3 when 0 then 'home' when 1 then 'global' else 'unclear' end"


@query(oracle(f"""select category, query_id, "group", round(avg(on_ - off_), 6) as gain from gains join (select brand, {_ORIGIN} as "group" from registry) using (brand) where "group" <> 'unclear' group by 1, 2, 3""", GAINS))
def origin_groups(s, d):
    brands = c.registry(s, d)
    groups = co.origins(brands, brands.select("brand", F.expr(_ORIGIN).alias("origin")))
    return co.group_gains(co.query_gains(c.pairs(s, d)), groups, ["brand"]).withColumn("gain", F.round("gain", 6))


# ---- intervals and effects ------------------------------------------------------------------------------------------
def bootstrap_sql(blocks: str, by: str, draws: int = 400, seed: int = 42) -> list[str]:
    """The interval of sum(a) / sum(b) over blocks, with the same MD5 draws."""
    keys = [x.strip() for x in by.split(",")]
    return [
        f"numbered as (select {by}, cast(a as double) as a, cast(b as double) as b, row_number() over (partition by {by} order by query_id) - 1 as k, count(*) over (partition by {by}) as n from {blocks})",
        f"slots as (select {by}, draw, cast('0x' || substr(md5(concat_ws('|', '{seed}', cast(draw as varchar), cast(k as varchar))), 1, 8) as bigint) % n as k from numbered cross join (select range as draw from range({draws})))",
        f"sums as (select {by}, draw, round(sum(a) / nullif(sum(b), 0), 9) as v from slots join numbered using ({by}, k) group by {by}, draw)",
        f"boot as (select {by}, estimate, round(low, 6) as low, round(high, 6) as high from (select {by}, round(sum(a) / nullif(sum(b), 0), 6) as estimate from numbered group by {by}) join (select {by}, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from sums group by {by}) using ({', '.join(keys)}))",
    ]


@query(oracle("select * from boot", FILTERED, RANKED, "blocks as (select category, query_id, count(*) filter (where y_top = 1) as a, count(*) as b from ranked where place = 1 and positives = 1 group by 1, 2)", *bootstrap_sql("blocks", "category", 400)))
def top1_ci(s, d):
    return ef.bootstrap_ratio(me.top1_blocks(_few(s, d)), ["category"], draws=400)


@query(oracle("select * from boot", FILTERED, RANKED, GAIN, "blocks as (select category, query_id, round(sum(ndcg), 9) as a, count(*) as b from gain group by 1, 2)", *bootstrap_sql("blocks", "category", 400)))
def ndcg_ci(s, d):
    blocks = me.gain(_kept(s, d)).groupBy("category", "query_id").agg(F.round(F.sum("ndcg"), 9).alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return ef.bootstrap_ratio(blocks, ["category"], draws=400)


@query(oracle('select * from boot', GAINS, BGAINS, TERC, 'blocks as (select "group", query_id, round(avg(on_ - off_), 9) as a, 1.0 as b from gains join terc using (category, brand) group by 1, 2)', *bootstrap_sql("blocks", '"group"', 2000)))
def group_gain_ci(s, d):
    gains = reused(co.query_gains(c.pairs(s, d)))
    blocks = gains.join(co.terciles(co.brand_gains(gains)), ["category", "brand"]).groupBy("group", "query_id").agg(F.round(F.avg("gain"), 9).alias("a"), F.lit(1.0).alias("b"))
    return ef.bootstrap_ratio(blocks, ["group"], draws=2000)


CONCORD = """concord as (select category, query_id, cast(sum(upto - eq) as bigint) as concordant, cast(sum(tot - upto) as bigint) as discordant, cast(sum(tot) as bigint) as compared from (
  select category, query_id, y_top, sum(1 - y_top) over (partition by record_id order by {f} range between unbounded preceding and current row) as upto, sum(1 - y_top) over (partition by record_id, {f}) as eq, sum(1 - y_top) over (partition by record_id) as tot from kept) where y_top = 1 group by 1, 2)"""
EFFECT = "select category, round({s} * cast(sum(concordant) - sum(discordant) as double) / sum(compared), 6) as effect, cast(sum(compared) as bigint) as comparisons, count(*) as queries from concord where compared > 0 group by 1"


@query(oracle(EFFECT.format(s=1), FILTERED, CONCORD.format(f="n_results_mentioning")))
def concordance_effect(s, d):
    return ef.effect(ef.concordance(_few(s, d), "n_results_mentioning", times="m"))


MATCHED = CONCORD.format(f="n_official").replace("partition by record_id", "partition by record_id, n_results_mentioning")


@query(oracle(EFFECT.format(s=1), FILTERED, MATCHED))
def matched_effect(s, d):
    return ef.effect(ef.concordance(_kept(s, d), "n_official", "n_results_mentioning"))


@query(oracle("select category, estimate, low, high, queries, case when queries < 5 then 'n/a' when low > 0 then 'up' when high < 0 then 'down' else 'flat' end as direction from boot join (select category, count(*) as queries from blocks group by 1) using (category)", FILTERED, CONCORD.format(f="n_results_mentioning"),
    "blocks as (select category, query_id, concordant - discordant as a, compared as b from concord where compared > 0)", *bootstrap_sql("blocks", "category", 1000)))
def signal_direction(s, d):
    return _direction(s, d, "n_results_mentioning")


def _direction(s: SparkSession, d: str, feature: str) -> DataFrame:
    return _directions(ef.concordance(_few(s, d), feature, times="m"))


def _directions(concordant: DataFrame) -> DataFrame:
    rows = reused(concordant.where("compared > 0"))
    blocks = rows.select("category", "query_id", (F.col("concordant") - F.col("discordant")).cast("double").alias("a"), F.col("compared").cast("double").alias("b"))
    return ef.direction(ef.bootstrap_ratio(blocks, ["category"], draws=1000).join(rows.groupBy("category").agg(F.count(F.lit(1)).alias("queries")), "category"))


def _stability_sql() -> str:
    parts = [FILTERED]
    for i, f in enumerate(("n_official", "n_forum")):
        own = [CONCORD.format(f=f).replace("concord as", f"concord{i} as", 1), f"blocks{i} as (select category, query_id, concordant - discordant as a, compared as b from concord{i} where compared > 0)"]
        for x in bootstrap_sql(f"blocks{i}", "category", 1000):
            for name in ("numbered", "slots", "sums", "boot"):
                x = x.replace(f"{name} as (", f"{name}{i} as (").replace(f"from {name}", f"from {name}{i}").replace(f"join {name} ", f"join {name}{i} ")
            own.append(x)
        parts += own
    union = " union all ".join(f"select '{f}' as signal, case when queries < 5 then 'n/a' when low > 0 then 'up' when high < 0 then 'down' else 'flat' end as direction from boot{i} join (select category, count(*) as queries from blocks{i} group by 1) using (category)" for i, f in enumerate(("n_official", "n_forum")))
    return oracle(f"""select signal, up, down, known, case when up > 0 and down > 0 then 'conflicting' when greatest(up, down) >= 4 and 3 * greatest(up, down) >= 2 * known then 'strong' when greatest(up, down) >= 2 then 'moderate' else 'weak' end as stability
      from (select signal, count(*) filter (where direction = 'up') as up, count(*) filter (where direction = 'down') as down, count(*) filter (where direction <> 'n/a') as known from ({union}) group by 1)""", *parts)


@query(_stability_sql())
def stability_class(s, d):
    rows, found = None, reused(ef.concordances(_few(s, d), ["n_official", "n_forum"], "m"))
    for f in ("n_official", "n_forum"):
        part = _directions(found.where(F.col("signal") == f)).select(F.lit(f).alias("signal"), "direction")
        rows = part if rows is None else rows.unionByName(part)
    return ef.stability(rows)


OUTCOMES = "outcomes as (select category, query_id, brand as target, model_id as arm, cast(y_mention as double) as value from pairs where condition = 'search_on')"


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return c.pairs(s, d).where("condition = 'search_on'").select("category", "query_id", F.col("brand").alias("target"), F.col("model_id").alias("arm"), F.col("y_mention").cast("double").alias("value"))


CELLS = "cells as (select category, query_id, target, arm, avg(value) as v from outcomes group by 1, 2, 3, 4)"


@query(oracle("""select coalesce(category, 'ALL') as scope, arm, round(avg(v), 6) as arm_rate, round(avg(b), 6) as baseline_rate, round(avg(v - b), 6) as effect, count(b) as cells
  from (select o.category, o.arm, o.v, r.v as b from cells o left join (select * from cells where arm = '1-URGENT') r using (category, query_id, target) where o.arm <> '1-URGENT') group by grouping sets ((category, arm), (arm))""", OUTCOMES, CELLS))
def arm_contrast(s, d):
    return ef.arm_contrast(_outcomes(s, d), "1-URGENT")


@query(oracle("select * from boot", OUTCOMES, CELLS, "blocks as (select o.arm, concat_ws('|', category, query_id, target) as query_id, round(o.v - r.v, 9) as a, 1.0 as b from cells o join (select * from cells where arm = '1-URGENT') r using (category, query_id, target) where o.arm <> '1-URGENT')", *bootstrap_sql("blocks", "arm", 2000)))
def arm_contrast_ci(s, d):
    return ef.bootstrap_ratio(ef.contrast_blocks(_outcomes(s, d), "1-URGENT"), ["arm"], draws=2000)


@query(oracle("select sentence, count(*) as appearances, cast(sum(won) as bigint) as wins, round(cast(sum(won) as double) / count(*), 6) as share from (select cast(l_partkey % 13 as integer) as sentence, case when l_extendedprice = max(l_extendedprice) over (partition by l_orderkey) then 1 else 0 end as won from lineitem) group by 1"))
def tournament_shares(s, d):
    from pyspark.sql import Window

    best = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    cards = c.table(s, d, "lineitem").select((F.col("l_partkey") % 13).cast("int").alias("sentence"), (F.col("l_extendedprice") == best).cast("int").alias("won"))
    return ef.win_shares(cards)


# ---- designs --------------------------------------------------------------------------------------------------------
@query(oracle("""select query_id, model_id, condition, run, concat_ws('_', model_id, condition, query_id, lpad(cast(run as varchar), 3, '0')) as cell_id from (select distinct query_id from responses) cross join (select distinct model_id from responses)
  cross join (select distinct condition from responses) cross join (select cast(range as integer) as run from range(1, 4))"""))
def plan_cells(s, d):
    rows = c.responses(s, d)
    return de.cells(*(rows.select(x).distinct() for x in ("query_id", "model_id", "condition")), 3)


@query(oracle("""select category, step, round, slot, (slot + round + step) % 5 as brand, (round + slot * step) % 13 as sentence from (select distinct category from responses) cross join (select cast(range as integer) as step from range(1, 7))
  cross join (select cast(range as integer) as round from range(13)) cross join (select cast(range as integer) as slot from range(5))"""))
def tournament_plan(s, d):
    return de.tournament(c.responses(s, d).select("category").distinct())


@query(oracle("""select record_id, cast(case when position >= 3 then position + 1 else position end as integer) as position, host from results union all select record_id, cast(least(3, max(position) + 1) as integer), 'inserted.example.com' from results group by 1"""))
def arm_insert_positions(s, d):
    return de.insert_page(c.results(s, d), 3)


# ---- text -----------------------------------------------------------------------------------------------------------
_FOLD = "lower(translate(coalesce(text, ''), 'İIı', 'iii'))"
_KEY = f"concat(' ', trim(regexp_replace({_FOLD}, '[^0-9a-zçğöşü]+', ' ', 'g')), ' ')"
#: Terms that occur in the given texts; the lexicon of the package is English and tested on English.
LEXICON = {"authority": ["the", "und", "que la"], "social_proof": ["of the", "la", "les"], "specificity": ["with", "der", "en"], "hedging": ["from", "nicht", "por"], "superlative": ["best", "top", "der die"]}
_LEX = ", ".join("(" + " + ".join(f"cast((length(k) - length(replace(k, ' {t} ', ''))) / {len(t) + 2} as bigint)" for t in terms) + f") as lex_{g}" for g, terms in LEXICON.items())


@query(f"select doc_id, md5({_KEY}) as key_hash, length({_KEY}) as key_length from documents")
def text_key(s, d):
    k = tx.text_key(F.col("text"))
    return c.table(s, d, "documents").select("doc_id", F.md5(k).alias("key_hash"), F.length(k).cast("long").alias("key_length"))


@query(f"select doc_id, {_LEX} from (select doc_id, {_KEY} as k from documents)")
def lexicon_features(s, d):
    rows = c.table(s, d, "documents").select("doc_id", tx.text_key(F.col("text")).alias("k"))
    return rows.select("doc_id", *tx.lexicon_counts(F.col("k"), LEXICON))


@query(r"""select conv_id, turn, length(text) as chars, cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as bigint) as words, regexp_matches(text, '(?m)^#{1,6} ') as has_headers,
  len(regexp_extract_all(text, '(?m)^\|.*\|$')) >= 2 as has_table, regexp_matches(text, '(?m)^[ \t]*[0-9]+[.)] ') as has_numbered, regexp_matches(text, '(?m)^[ \t]*[-*] ') as has_bullets, regexp_matches(text, '\b(19|20)[0-9]{2}\b') as has_year,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(cast(length(text) as double), 0), 6) as digit_share from conversations where role = 'assistant'""")
def deterministic_features(s, d):
    return c.table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", *tx.structure(F.col("text")))


@query(r"select page_id, nullif(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '') as host from pages")
def url_host(s, d):
    return c.table(s, d, "pages").select("page_id", ur.host(F.col("url")).alias("host"))


_BARE = r"regexp_replace(nullif(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1), ''), '^www\.', '')"


@query(f"""select page_id, case when n >= 3 and p[n - 1] in ({', '.join(repr(x) for x in ur.SECOND_LEVEL)}) and length(p[n]) = 2 then p[n - 2] when n >= 2 then p[n - 1] else p[1] end as label from (select page_id, p, len(p) as n from (select page_id, string_split({_BARE}, '.') as p from pages))""")
def host_label(s, d):
    return c.table(s, d, "pages").select("page_id", ur.host_label(F.col("url")).alias("label"))


RULES = [("example.org", "editorial"), ("example.com", "retailer"), ("example.net", "forum"), ("blog.tionble.example.com", "affiliate"), ("com", "official"), ("net", "affiliate")]
_RULES = "rules as (select * from (values " + ", ".join(map(str, RULES)) + ") v(domain, kind))"
_HOSTS = f"hosts as (select distinct {_BARE} as host from pages where {_BARE} is not null)"
_FITS = "fits as (select h.host, r.domain, r.kind from hosts h join rules r on h.host = r.domain or ends_with(h.host, '.' || r.domain))"
ORDER = ["official", "retailer", "forum", "affiliate", "editorial"]


def _rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RULES, "domain string, kind string")


def _hosts(s: SparkSession, d: str) -> DataFrame:
    return c.table(s, d, "pages").select(ur.bare_host(F.col("url")).alias("host")).where("host is not null").distinct()


@query(f"with {_RULES}, {_HOSTS}, {_FITS} select host, coalesce(kind, 'unknown') as kind from hosts left join (select host, kind from (select *, row_number() over (partition by host order by list_position({ORDER}, kind)) as rn from fits) where rn = 1) using (host)")
def source_type_precedence(s, d):
    return ur.kind_by_precedence(_hosts(s, d), _rules(s), ORDER)


@query(f"with {_RULES}, {_HOSTS}, {_FITS} select host, coalesce(kind, 'unknown') as kind from hosts left join (select host, kind from (select *, row_number() over (partition by host order by length(domain) desc) as rn from fits) where rn = 1) using (host)")
def source_type_longest(s, d):
    return ur.kind_by_longest(_hosts(s, d), _rules(s))


@query(f"""with {_RULES}, {_HOSTS}, {_FITS}, a as (select coalesce(kind, 'unknown') as kind from hosts left join (select host, kind from (select *, row_number() over (partition by host order by list_position({ORDER}, kind)) as rn from fits) where rn = 1) using (host)),
  b as (select coalesce(kind, 'unknown') as kind from hosts left join (select host, kind from (select *, row_number() over (partition by host order by length(domain) desc) as rn from fits) where rn = 1) using (host))
  select kind, coalesce(x, 0) as v1, coalesce(y, 0) as v2 from (select kind, round(count(*) / cast(sum(count(*)) over () as double), 6) as x from a group by 1) full join (select kind, round(count(*) / cast(sum(count(*)) over () as double), 6) as y from b group by 1) using (kind)""")
def taxonomy_shift(s, d):
    hosts = _hosts(s, d)
    both = ur.kind_by_precedence(hosts, _rules(s), ORDER).withColumn("v", F.lit("v1")).unionByName(ur.kind_by_longest(hosts, _rules(s)).withColumn("v", F.lit("v2")))
    wide = both.groupBy("kind").pivot("v", ["v1", "v2"]).count().na.fill(0)
    total = wide.agg(F.sum("v1").alias("t1"), F.sum("v2").alias("t2"))
    return wide.crossJoin(F.broadcast(total)).select("kind", ra.ratio(F.col("v1"), F.col("t1")).alias("v1"), ra.ratio(F.col("v2"), F.col("t2")).alias("v2"))


@query()
def alias_candidates(s, d):
    return tx.alias_pairs(c.table(s, d, "part").select(F.lower("p_name").alias("name")).distinct(), 0.82)


# ---- integrity ------------------------------------------------------------------------------------------------------
_CANON = "concat_ws('|', " + ", ".join(f"coalesce(concat(length(cast({x} as varchar)), ':', cast({x} as varchar)), '~')" for x in ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")) + ")"


@query(f"select o_orderkey, sha256({_CANON}) as content_hash from orders")
def content_hash(s, d):
    return it.content_hash(c.table(s, d, "orders"), "o_orderkey", ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"])


_PARTS = ", ".join(f"cast(bit_xor(cast('0x' || substr(x, {1 + 15 * i}, 15) as bigint)) as varchar), cast(sum(cast('0x' || substr(x, {1 + 15 * i}, 15) as bigint)) as varchar)" for i in range(4))


@query(f"select o_orderpriority, sha256(concat_ws('|', cast(count(*) as varchar), {_PARTS})) as table_hash from (select o_orderpriority, sha256({_CANON}) as x from orders) group by 1")
def canonical_hash(s, d):
    rows = c.table(s, d, "orders")
    hashes = rows.select("o_orderpriority", F.sha2(it.canonical("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), 256).alias("content_hash"))
    return it.table_hash(hashes, "o_orderpriority")


@query("select status, count(*) filter (where rn = 1) as current, count(*) filter (where rn > 1) as superseded from (select case when event_type = 'error' then 'error' else 'completed' end as status, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) group by 1")
def status_summary(s, d):
    rows = c.table(s, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return it.status_summary(rows)


@query("select user_id as key, count(*) as attempts, case when max(case when event_type = 'purchase' then 1 else 0 end) = 1 then 'done' when count(*) >= 3 then 'exhausted' else 'open' end as state from events group by 1")
def receipt_states(s, d):
    return it.receipts(c.table(s, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "ok").otherwise("tried").alias("status")))


@query("select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def planned_not_completed(s, d):
    rows = c.table(s, d, "orders")
    return it.still_open(rows, rows.where("o_orderstatus = 'F'"), "o_custkey")


@query("""select state, count(*) as n from (select case when j.h is null then 'missing' when j.h = c.h then 'current' else 'stale' end as state from (select o_orderkey as key, md5(o_orderstatus) as h from orders) c
  left join (select l_orderkey as key, md5(max(l_linestatus)) as h from lineitem group by 1) j using (key)) group by 1""")
def judge_currency(s, d):
    """Orders judged by the last status of their lines: another status today is stale, no line at all is missing."""
    judged = c.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.md5(F.max("l_linestatus")).alias("content_hash"))
    return it.judgement_currency(judged, c.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.md5("o_orderstatus").alias("content_hash")))


@query("""select key, longest, longest >= 5 as open from (select key, coalesce(max(case when failed = 1 then n end), 0) as longest from (select key, failed, island, count(*) as n from (select user_id as key, case when event_type = 'error' then 1 else 0 end as failed,
  row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, case when event_type = 'error' then 1 else 0 end order by ts, event_id) as island from events) group by 1, 2, 3) group by 1)""")
def circuit_breaker(s, d):
    return it.breaker(c.table(s, d, "events").select(F.col("user_id").alias("key"), (F.col("event_type") == "error").cast("int").alias("failed"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query("select event_id, event_type, json_extract_string(props, '$.k') as props__k from events")
def json_flatten(s, d):
    return it.json_fields(c.table(s, d, "events"), "props", ["k"]).select("event_id", "event_type", "props__k")


@query("select event_type, count(*) as n, cast(epoch_us(min(ts)) as bigint) as first_us, cast(epoch_us(max(ts)) as bigint) as last_us from events group by 1")
def export_distribution(s, d):
    return c.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


from lexigauge.plans import answers_catalogue, checks_catalogue, explain_catalogue, lab_catalogue, live_catalogue, panel_catalogue, site_catalogue  # noqa: E402, F401  they register their queries
