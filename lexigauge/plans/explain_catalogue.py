"""Registered queries that explain scores: contributions of trees, rank correlations, permutations, joint intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators import contributions as co
from lexigauge.operators import models as mo
from lexigauge.operators import ordering as od
from lexigauge.operators import panel as pa
from lexigauge.operators import resampling as rs
from lexigauge.plans.lab_catalogue import ap_sql, draws_sql
from lexigauge.plans.registry import query
from lexigauge.sources import corpus as c
from lexigauge.sources.corpus import oracle

KEPT = "kept as (select * from scored where condition = 'search_on' and confidence <> 'low' and response_decided = 1)"
#: Two relative features of every kept candidate, with its keys.
DESIGN = """design as (
  select record_id, brand, category, query_id, y_top,
    round(coalesce(n_results_mentioning / nullif(cast(n_results as double), 0), 0), 6) as volume_share,
    round(case when in_search_results = 1 then (
        rank() over (partition by record_id, in_search_results order by -best_position)
        + (count(*) over (partition by record_id, in_search_results, best_position) - 1) / 2.0e0
      ) / count(*) over (partition by record_id, in_search_results) else 0 end, 6) as position_rank_pct
  from kept left join (select record_id, count(*) as n_results from results group by 1) using (record_id))"""


def design(s: SparkSession, d: str) -> DataFrame:
    """The rows that models see: relative features, keys and label of every candidate that counts."""
    return pa.relative(pa.panel_filter(c.pairs(s, d, sizes=True)), keep=("category", "query_id", "model_id"))


def folded_design(s: SparkSession, d: str) -> DataFrame:
    """``design`` with an answer's unseen candidates as one row: brand null for these, and m, how many a row stands for."""
    return pa.relative(pa.panel_filter(c.folded(s, d, sizes=True)).where("m > 0"), keep=("category", "query_id", "model_id", "m"), times="m")


# ---- contributions --------------------------------------------------------------------------------------------------
#: A tree of given splits, in heap order: volume_share is asked twice on the right.
SPLITS = [("volume_share", 0.2), ("position_rank_pct", 0.5), ("volume_share", 0.34), None, None, None, None]
_TREE = """leaves as (
  select *, case when volume_share <= 0.2 then case when position_rank_pct <= 0.5 then 0 else 1 end when volume_share <= 0.34 then 2 else 3 end as leaf from design),
stats as (
  select count(*) as n, {0} from leaves),
played as (
  select d.*, (n0 * v0 + n1 * v1 + n2 * v2 + n3 * v3) / n as v_none,
    case leaf when 2 then v2 when 3 then v3 else (n0 * v0 + n1 * v1) / nullif(n0 + n1, 0) end as v_volume,
    ((n0 + n1) * case when position_rank_pct <= 0.5 then v0 else v1 end + n2 * v2 + n3 * v3) / n as v_position,
    case leaf when 0 then v0 when 1 then v1 when 2 then v2 else v3 end as v_both
  from leaves d, stats),
parts as (
  select category, 'volume_share' as feature, volume_share as x, (v_volume - v_none + v_both - v_position) / 2 as phi from played
  union all select category, 'position_rank_pct', position_rank_pct, (v_position - v_none + v_both - v_volume) / 2 from played)""".format(
    ", ".join(f"cast(count(*) filter (where leaf = {k}) as double) as n{k}, coalesce(avg(y_top) filter (where leaf = {k}), 0) as v{k}" for k in range(4))
)
_SPEARMAN = """ranked as (
  select *, rank() over (partition by {by} order by {a}) + (count(*) over (partition by {by}, {a}) - 1) / 2.0e0 as ra,
    rank() over (partition by {by} order by {b}) + (count(*) over (partition by {by}, {b}) - 1) / 2.0e0 as rb
  from {of}),
spearman as (
  select {by}, count(*) as n, case when count(distinct ra) > 1 and count(distinct rb) > 1 then round(corr(ra, rb), 6) end as correlation
  from ranked group by {by})"""


@query(oracle(
    """select category, feature, share, correlation as direction from (
      select category, feature, round(coalesce(a / nullif(sum(a) over (partition by category), 0), 0), 6) as share
      from (select category, feature, avg(abs(phi)) as a from parts group by 1, 2)) join spearman using (category, feature)""",
    KEPT, DESIGN, _TREE, "rounded as (select category, feature, round(x, 9) as a, round(phi, 9) as b from parts)",
    _SPEARMAN.format(of="rounded", by="category, feature", a="a", b="b"),
))
def given_tree_shares(s, d):
    """What two features contribute to a tree of given splits: shares, and whether larger values add or take away."""
    names = ["volume_share", "position_rank_pct"]
    rows, keys = mo.cells(folded_design(s, d), names, ["category", "y_top"], "m"), ["category", *names, "m"]
    tree = co.grown(rows, names, SPLITS, "y_top", "m")
    found = co.by_feature(co.contributions(rows.withColumn("x", F.array(*names)), "x", keys, [tree], [1.0]), names, keys)
    found = od.reused(found.withColumn("value", _value(names)))
    return co.shares(found, ["category"], "m").join(co.directions(found, None, keys, ["category"], "m"), ["category", "feature"])


def _value(names: list[str]) -> Column:
    """The value of the feature that a row of contributions speaks of."""
    return F.coalesce(*[F.when(F.col("feature") == n, F.col(n)) for n in names])


@query()
def boosted_shares(s, d):
    """Shares and directions of all features in boosted trees that are asked about folds they have not seen.

    Features of content are compared among retrieved candidates only.
    """
    found = mo.explained_out_of_fold(design(s, d), pa.folds(c.responses(s, d), 3), 3, ["category"], ("model_id",))
    found = od.reused(found.withColumn("value", F.when(F.col("volume_share") > 0, _value(mo.FEATURES))))
    return co.shares(found, ["category"], "m").join(co.directions(found, None, [], ["category"], "m"), ["category", "feature"], "left")


@query(oracle("select category, n, correlation from spearman", KEPT, DESIGN, _SPEARMAN.format(of="design", by="category", a="volume_share", b="position_rank_pct")))
def rank_correlations(s, d):
    """Spearman's correlation of volume and place per category, over all candidates."""
    return od.rank_correlation(folded_design(s, d), ["category"], "volume_share", "position_rank_pct", "m")


# ---- models ---------------------------------------------------------------------------------------------------------
@query()
def tree_scores(s, d):
    """Every candidate scored by boosted trees that saw no query of its fold, with the answering model as a category."""
    return mo.out_of_fold(design(s, d), pa.folds(c.responses(s, d), 3), 3, "trees", ("model_id",))


@query(oracle(
    """select o.record_id, o.brand, o.category, p.volume_share from own o join other p on o.category = p.category and o.place = p.place""",
    KEPT, DESIGN, "own as (select *, row_number() over (partition by category order by record_id, brand) as place from design)",
    """other as (select category, volume_share, row_number() over (partition by category order by md5(concat(record_id, '|', brand, '|7')), concat(record_id, '|', brand)) as place from design)""",
))
def dealt_feature(s, d):
    """One feature dealt anew over each whole category: an exact permutation."""
    rows = design(s, d).select("record_id", "brand", "category", "volume_share")
    return mo.permuted(rows, "volume_share", 7)


@query()
def out_of_domain_drops(s, d):
    """Average precision of a model of the other categories, and what it loses when a feature is dealt anew, three times."""
    return mo.out_of_domain_drops(folded_design(s, d), ["volume_share", "position_rank_pct", "share_official"], repeats=3, brands=c.registry(s, d), times="m")


# ---- joint intervals ------------------------------------------------------------------------------------------------
_SIDES = """sides as (
  select *, score as x0, round(case when n_results_mentioning > 0 then n_results_mentioning / 10.0e0 else 0.0e0 end, 6) as x1 from kept)"""
_LISTS = """places{k} as (
  select category, query_id, record_id, y_top, row_number() over (partition by record_id order by x{k} desc, brand) as place, sum(y_top) over (partition by record_id) as positives from sides),
lists{k} as (
  select category, query_id, record_id, any_value(positives) as positives, max(case when place = 1 then y_top end) as hit,
    sum(case when place <= 3 then y_top / log2(place + 1.0e0) end) as gain from places{k} group by 1, 2, 3),
blocks{k} as (
  select category, query_id, count(*) filter (where positives = 1 and hit = 1) as hits{k}, count(*) filter (where positives = 1) as usable{k},
    coalesce(round(sum(case when positives > 0 then gain / (1.0e0 + case when positives > 1 then 1 / log2(3.0e0) else 0 end + case when positives > 2 then 0.5e0 else 0 end) end), 9), 0) as gain{k},
    count(*) filter (where positives > 0) as lists{k} from lists{k} group by 1, 2)"""
_MEASURES = """round((sum(hits0 * {t}) - sum(hits1 * {t})) / nullif(cast(sum(usable0 * {t}) as double), 0), 9) as top1,
  round(sum(gain0 * {t}) / nullif(sum(lists0 * {t}), 0) - sum(gain1 * {t}) / nullif(sum(lists1 * {t}), 0), 9) as ndcg"""
_AP = """point{k} as (
  select category, case when max(p) > 0 and max(p) < max(seen) then round(sum(h * tp / cast(seen as double)) / max(p), 6) end as p{k} from (
    select category, h, sum(h) over w as tp, sum(n) over w as seen, sum(h) over (partition by category) as p
    from (select category, x{k} as x, sum(y_top) as h, count(*) as n from sides group by 1, 2) window w as (partition by category order by x desc)) group by 1)"""
_ENDS = ", ".join(f"round(quantile_cont({n}, {q}), 6) as {n}_{tag}" for n in ("precision", "top1", "ndcg") for q, tag in ((0.025, "low"), (0.975, "high")))


@query(oracle(
    """select category, n_blocks as blocks, round(p0 - p1, 6) as precision_delta, precision_low, precision_high, round(top1, 6) as top1_delta, top1_low, top1_high,
      round(ndcg, 6) as ndcg_delta, ndcg_low, ndcg_high
    from whole join point0 using (category) join point1 using (category) join ends using (category)""",
    KEPT, _SIDES, _LISTS.format(k=0), _LISTS.format(k=1), "blocks as (select * from blocks0 join blocks1 using (category, query_id))", draws_sql("kept", "category", "query_id", 400),
    "whole as (select category, count(*) as n_blocks, " + _MEASURES.format(t="1") + " from blocks group by 1)",
    "drawn as (select category, draw, " + _MEASURES.format(t="times") + " from blocks join times using (category, query_id) group by 1, 2)",
    ap_sql("a", "score"), ap_sql("b", "round(case when n_results_mentioning > 0 then n_results_mentioning / 10.0e0 else 0.0e0 end, 6)"),
    "values_ as (select *, round(a.v - b.v, 9) as precision from drawn join apa a using (category, draw) join apb b using (category, draw))",
    f"ends as (select category, {_ENDS} from values_ group by 1)", _AP.format(k=0), _AP.format(k=1),
))
def joint_deltas_ci(s, d):
    """Position against volume as a score: three differences, with intervals from the same 400 draws of queries."""
    rows = c.scored(pa.panel_filter(c.pairs(s, d)))
    other = F.round(F.when(F.col("n_results_mentioning") > 0, F.col("n_results_mentioning") / F.lit(10.0)).otherwise(F.lit(0.0)), 6)
    return rs.joint_deltas(rows.withColumn("volume", other), "score", "volume")
