"""Bootstrap intervals of statistics that are no ratio of sums: the draws are the same on every engine.

Rows are first aggregated to blocks (queries, cells, calls). A draw picks as many blocks as there are, by MD5 of seed, draw
and slot; how often a block is picked becomes its weight. Weighted sums over blocks then give the statistic of a draw, so
draws multiply blocks, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators import metrics as mt
from lexigauge.operators.effects import draw
from lexigauge.operators.ordering import reused


def weights(blocks: DataFrame, by: list[str], block: str, draws: int, seed: int = 42) -> DataFrame:
    """``by``, block, draw, times: how often each draw picks a block; blocks that it does not pick are absent."""
    group = Window.partitionBy(*by)
    numbered = blocks.select(*by, block).distinct().select(*by, block, (F.row_number().over(group.orderBy(block)) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(group).alias("n"))
    times = F.broadcast(blocks.sparkSession.range(draws).withColumnRenamed("id", "draw"))
    slots = numbered.select(*by, F.col("k").alias("slot"), "n").crossJoin(times).select(*by, "draw", draw(seed, F.col("n")).alias("k"))
    picked = slots.groupBy(*by, "draw", "k").agg(F.count(F.lit(1)).alias("times"))
    return picked.join(numbered.select(*by, block, "k"), [*by, "k"]).select(*by, block, "draw", "times")


def ends(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """low and high per group: the 2.5 and 97.5 percentiles over draws, nulls skipped."""
    return values.groupBy(*by).agg(F.round(F.percentile(value, 0.025), 6).alias("low"), F.round(F.percentile(value, 0.975), 6).alias("high"))


def draw_vectors(blocks: DataFrame, by: list[str], block: str, draws: int, seed: int = 42) -> DataFrame:
    """``by``, block, picks array<struct<draw, times>>: how often each draw picks a block, as one sparse vector."""
    return weights(blocks, by, block, draws, seed).groupBy(*by, block).agg(F.collect_list(F.struct("draw", "times")).alias("picks"))


#: Rows of which a worker holds the draw counts at once (each is a vector of as many numbers as there are draws).
CHUNK = 2048


def _vectors(table: pa.Table, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice in falling order of its scores: last row of each score, hits, n, block of each row, and draw counts by block."""
    score = table.column("score").to_numpy()
    order = np.argsort(-score, kind="stable")
    score = score[order]
    ends = np.append(score[1:] != score[:-1], True)
    blocks = table.column("_block").combine_chunks().dictionary_encode()
    code = blocks.indices.to_numpy()
    times = np.zeros((len(blocks.dictionary), draws))
    _, where = np.unique(code, return_index=True)
    picks = table.column("picks").take(where).combine_chunks()
    at = np.repeat(code[where], np.diff(picks.offsets.to_numpy()))
    flat = picks.flatten()
    times[at, flat.field("draw").to_numpy()] = flat.field("times").to_numpy()
    return ends, table.column("hits").to_numpy()[order], table.column("n").to_numpy()[order], code[order], times


def average_precision_draws(scored: DataFrame, by: str | list[str], block: str, draws: int, label: str = "y_top", seed: int = 42) -> DataFrame:
    """by, draw, v: average precision of every draw of blocks; null where a draw has one label only.

    Rows are counted per (block, score) and carry their block's vector of draw counts; no row is multiplied by draws. The
    counts are range-partitioned by falling score. A first pass adds up the vectors of every slice, whose sums before a
    slice are its offsets; a second pass runs through the slice with vectors of hits and rows seen, one step per score.
    """
    by = [by] if isinstance(by, str) else by
    steps = reused(scored.groupBy(*by, block, "score").agg(F.sum(label).cast("long").alias("hits"), F.count(F.lit(1)).alias("n")))
    rows = steps.join(draw_vectors(steps, by, block, draws, seed), [*by, block]).select(*by, F.col(block).cast("string").alias("_block"), F.col("score").cast("double").alias("score"), "hits", "n", "picks")
    rows = reused(rows.repartitionByRange(*by, F.desc("score")).withColumn("_slice", F.spark_partition_id()))
    keys = [*by, "_slice"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    named = [f.name for f in rows.schema if f.name in keys]

    def totals(table: pa.Table) -> pa.Table:
        _, hits, n, code, times = _vectors(table, draws)
        sums = [np.zeros(len(times)), np.zeros(len(times))]
        np.add.at(sums[0], code, hits)
        np.add.at(sums[1], code, n)
        own = table.select(named).slice(0, 1).take(pa.array(np.zeros(draws, np.int64)))
        return pa.table([*own.columns, pa.array(np.arange(draws)), *[pa.array(s @ times) for s in sums]], names=[*named, "draw", "h", "m"])

    sums = rows.groupBy(*keys).applyInArrow(totals, f"{kinds}, draw long, h double, m double")
    before = Window.partitionBy(*by, "draw").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "draw", F.coalesce(F.sum("h").over(before), F.lit(0.0)).alias("h"), F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("m"))

    def walk(table: pa.Table, offset: pa.Table) -> pa.Table:
        ends, hits, n, code, times = _vectors(table, draws)
        tp, seen, s = np.zeros(draws), np.zeros(draws), np.zeros(draws)
        at = offset.column("draw").to_numpy()
        tp[at], seen[at] = offset.column("h").to_numpy(), offset.column("m").to_numpy()
        done = tp.copy()  # hits up to the last whole step
        first = tp.copy()
        for i in range(0, len(code), CHUNK):
            picked = times[code[i : i + CHUNK]]
            up = tp + np.cumsum(picked * hits[i : i + CHUNK, None], 0)
            so_far = seen + np.cumsum(picked * n[i : i + CHUNK, None], 0)
            last = ends[i : i + CHUNK]
            steps = np.diff(up[last], axis=0, prepend=done[None])
            s += np.divide(steps * up[last], so_far[last], out=np.zeros_like(steps), where=so_far[last] > 0).sum(0)
            tp, seen = up[-1], so_far[-1]
            done = up[last][-1] if last.any() else done
        own = table.select(named).slice(0, 1).take(pa.array(np.zeros(draws, np.int64)))
        return pa.table([*own.columns, pa.array(np.arange(draws)), pa.array(s), pa.array(tp - first), pa.array(seen)], names=[*named, "draw", "s", "p", "n"])

    parts = rows.groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInArrow(walk, f"{kinds}, draw long, s double, p double, n double")
    out = parts.groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.max("n").alias("n"))
    return out.where("n > 0").select(*by, "draw", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.round(F.col("s") / F.col("p"), 9)).alias("v"))


def joint_deltas(rows: DataFrame, a: str, b: str, by: str = "category", block: str = "query_id", label: str = "y_top", draws: int = 400, seed: int = 42) -> DataFrame:
    """Per group: blocks, and delta, low, high of average precision, top-1 and NDCG at 3 of score ``a`` minus score ``b``.

    All three come from the same draws of blocks for both scores, so the intervals are those of the differences. Top-1 and
    NDCG are ratios of sums over blocks; rows with columns record_id, brand. A group of one block has no intervals; a
    measure that a draw cannot have is left out of its ends. An empty table gives an empty result.
    """
    rows = rows.select(*dict.fromkeys([by, block, "record_id", "brand", label, a, b]))
    sides = [rows.select(by, block, "record_id", "brand", F.col(label).alias("y_top"), F.col(x).cast("double").alias("score"), F.lit(k).alias("side")) for k, x in enumerate((a, b))]
    one = F.col("positives") == 1
    sums = []
    for k, side in enumerate(sides):
        lists = mt.ranked(side).groupBy(by, block, "record_id").agg(F.max("positives").alias("positives"), F.sum(F.when(F.col("place") == 1, F.col("y_top"))).alias("right"), F.sum(F.when(F.col("place") <= 3, F.col("y_top") / F.log2(F.col("place") + F.lit(1.0)))).alias("gain"))
        ideal = sum((F.when(F.col("positives") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(F.lit(0.0)) for i in (1, 2, 3)), F.lit(0.0))
        sums.append(lists.groupBy(by, block).agg(F.count_if(one & (F.col("right") == 1)).alias(f"hits{k}"), F.count_if(one).alias(f"usable{k}"), F.round(F.sum(F.when(F.col("positives") > 0, F.col("gain") / ideal)), 9).alias(f"gain{k}"), F.count_if(F.col("positives") > 0).alias(f"lists{k}")))
    blocks = reused(sums[0].join(sums[1], [by, block]).na.fill(0.0))  # from the rows as they lie, by answer
    rows = reused(rows.select(*dict.fromkeys([by, block, label, a, b])))
    sides = [rows.select(by, block, F.col(label).alias("y_top"), F.col(x).cast("double").alias("score"), F.lit(k).alias("side")) for k, x in enumerate((a, b))]
    drawn = blocks.join(weights(blocks, [by], block, draws, seed), [by, block])

    def measures(frame: DataFrame, keys: list[str], times: Column) -> DataFrame:
        total = lambda c: F.sum(F.col(c) * times)
        top = F.try_divide(total("hits0") - total("hits1"), total("usable0"))
        ndcg = F.try_divide(total("gain0"), total("lists0")) - F.try_divide(total("gain1"), total("lists1"))
        return frame.groupBy(*keys).agg(F.round(top.cast("double"), 9).alias("top1"), F.round(ndcg, 9).alias("ndcg"))

    both = sides[0].unionByName(sides[1])
    precise = average_precision_draws(both, [by, "side"], block, draws, seed=seed).groupBy(by, "draw")
    precise = precise.agg(F.round(F.max(F.when(F.col("side") == 0, F.col("v"))) - F.max(F.when(F.col("side") == 1, F.col("v"))), 9).alias("precision"))
    values = measures(drawn, [by, "draw"], F.col("times")).join(precise, [by, "draw"], "left")
    names = ("precision", "top1", "ndcg")
    end = lambda n, q, tag: F.round(F.percentile(n, q), 6).alias(f"{n}_{tag}")
    ends_ = values.groupBy(by).agg(*[end(n, q, tag) for n in names for q, tag in ((0.025, "low"), (0.975, "high"))])
    whole = [mt.average_precision(side, by=by).withColumnRenamed("average_precision", f"p{k}") for k, side in enumerate(sides)]
    point = measures(blocks, [by], F.lit(1)).join(blocks.groupBy(by).agg(F.count(F.lit(1)).alias("blocks")), by).join(whole[0], by, "left").join(whole[1], by, "left")
    point = point.select(by, "blocks", F.round(F.col("p0") - F.col("p1"), 6).alias("precision_delta"), F.round("top1", 6).alias("top1_delta"), F.round("ndcg", 6).alias("ndcg_delta"))
    several = lambda n, tag: F.when(F.col("blocks") > 1, F.col(f"{n}_{tag}")).alias(f"{n}_{tag}")
    return point.join(ends_, by, "left").select(by, "blocks", *[c for n in names for c in (F.col(f"{n}_delta"), several(n, "low"), several(n, "high"))])


def concentration_draws(events: DataFrame, by: list[str], block: str, draws: int, seed: int = 42) -> DataFrame:
    """by, draw, v: effective number of brands (inverse sum of squared shares) of every draw of blocks.

    events: by, block, brand, n.
    """
    events = reused(events)
    many = events.join(weights(events, by, block, draws, seed), [*by, block])
    per_brand = many.groupBy(*by, "draw", "brand").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    out = per_brand.groupBy(*by, "draw").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum("n").cast("double").alias("total"))
    return out.select(*by, "draw", F.round(F.try_divide(F.col("total") * F.col("total"), F.col("squares")), 9).alias("v"))


def concentration_intervals(panel: DataFrame, draws: int, k: int = 3, label: str = "y_mention", seed: int = 42) -> DataFrame:
    """Per category, condition and model (ALL: all models): brands, events, never_named, queries (with an event), and
    effective_brands, top_share and normalised_hhi, each with low and high.

    The queries of a category and condition are drawn, with and without events, and all three measures come from the same
    draws. Answers are counted by query and brand first, so draws meet blocks. A scope with events in one query only has
    no intervals; a scope without events has no measures. For y_top hand in decided answers only.
    """
    scope = ["category", "condition", "model_id"]
    sets = [[F.col(c) for c in (*scope, "query_id", "brand")], [F.col(c) for c in ("category", "condition", "query_id", "brand")]]
    panel = reused(panel.groupBy(*scope, "query_id", "brand").agg(F.sum(label).cast("long").alias("n")))  # the only pass over the rows
    events = panel.groupingSets(sets, *[F.col(c) for c in (*scope, "query_id", "brand")]).agg(F.sum("n").alias("n"))
    events = reused(events.withColumn("model_id", F.coalesce("model_id", F.lit("ALL"))))
    registered = panel.groupBy("category").agg(F.countDistinct("brand").alias("brands"))

    def measures(counts: DataFrame, keys: list[str]) -> DataFrame:
        """counts: keys, category, brand, n."""
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "brand")
        rows = counts.where("n > 0").withColumn("_place", F.row_number().over(order)).groupBy(*keys).agg(F.sum("n").cast("double").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q"), F.sum(F.when(F.col("_place") <= k, F.col("n"))).alias("top"))
        rows = rows.join(registered, "category")
        hhi, floor = F.col("q") / (F.col("t") * F.col("t")), 1.0 / F.col("brands")
        return rows.select(*keys, F.round(1.0 / hhi, 9).alias("effective_brands"), F.round(F.col("top") / F.col("t"), 9).alias("top_share"), F.when(F.col("brands") > 1, F.round((hhi - floor) / (1.0 - floor), 9)).alias("normalised_hhi"))

    totals = reused(events.groupBy(*scope, "brand").agg(F.sum("n").alias("n")))
    sizes = totals.groupBy(*scope).agg(F.sum("n").alias("events"), F.count_if(F.col("n") > 0).alias("named")).join(registered, "category")
    usable = events.where("n > 0").groupBy(*scope).agg(F.countDistinct("query_id").alias("queries"))
    point = sizes.join(usable, scope, "left").join(measures(totals, scope), scope, "left")
    drawn = events.where("n > 0").join(weights(panel, ["category", "condition"], "query_id", draws, seed), ["category", "condition", "query_id"])
    sums = drawn.groupBy(*scope, "draw", "brand").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    names = ("effective_brands", "top_share", "normalised_hhi")
    ends_ = measures(sums, [*scope, "draw"]).groupBy(*scope).agg(*[F.percentile(n, q).alias(f"{n}_{tag}") for n in names for q, tag in ((0.025, "low"), (0.975, "high"))])
    found = point.join(ends_, scope, "left")
    several = lambda c: F.when(F.col("queries") > 1, F.round(c, 6)).alias(c)
    zero = F.coalesce("queries", F.lit(0).cast("long"))
    return found.select(*scope, "brands", "events", (F.col("brands") - F.col("named")).alias("never_named"), zero.alias("queries"), *[c for n in names for c in (F.round(n, 6).alias(n), several(f"{n}_low"), several(f"{n}_high"))])


def ratio_draws(sums: DataFrame, by: list[str], block: str, draws: int, a: str = "a", b: str = "b", seed: int = 42) -> DataFrame:
    """by, draw, v: sum(a) / sum(b) over the drawn blocks."""
    sums = reused(sums)
    many = sums.join(weights(sums, by, block, draws, seed), [*by, block])
    return many.groupBy(*by, "draw").agg(F.round(F.try_divide(F.sum(F.col(a) * F.col("times")), F.sum(F.col(b) * F.col("times"))), 9).alias("v"))


def paired(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Difference of two statistics in the same draws: both must come from the same blocks and seed."""
    return first.join(second.withColumnRenamed("v", "_v"), [*by, "draw"]).select(*by, "draw", F.round(F.col("v") - F.col("_v"), 9).alias("v"))


def mean_interval(rows: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int = 42) -> DataFrame:
    """by, n, mean, low, high; groups of under two units have no interval. ``rows``: one per unit."""
    units = rows.select(*by, unit, F.col(value).cast("double").alias("a"), F.lit(1.0).alias("b"))
    point = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("mean"))
    out = point.join(ends(ratio_draws(units, by, unit, draws, seed=seed), by), by, "left")
    enough = lambda c: F.when(F.col("n") >= 2, F.col(c)).alias(c)
    return out.select(*by, "n", "mean", enough("low"), enough("high"))


def difference_interval(rows: DataFrame, by: list[str], unit: str, value: str, arm: Column, draws: int, seed: int = 42) -> DataFrame:
    """by, n_arm, n_base, effect, low, high: mean of the units of an arm minus that of the others, both drawn independently."""
    units = rows.select(*by, unit, F.col(value).cast("double").alias("a"), F.lit(1.0).alias("b"), F.coalesce(arm, F.lit(False)).alias("_arm"))
    one, two = units.where("_arm"), units.where("not _arm")
    delta = paired(ratio_draws(one, by, unit, draws, seed=seed), ratio_draws(two, by, unit, draws, seed=seed + 1), by)
    point = units.groupBy(*by).agg(F.count_if("_arm").alias("n_arm"), F.count_if(~F.col("_arm")).alias("n_base"), F.round(F.avg(F.when(F.col("_arm"), F.col("a"))) - F.avg(F.when(~F.col("_arm"), F.col("a"))), 6).alias("effect"))
    out = point.join(ends(delta, by), by, "left")
    enough = lambda c: F.when((F.col("n_arm") >= 2) & (F.col("n_base") >= 2), F.col(c)).alias(c)
    return out.select(*by, "n_arm", "n_base", "effect", enough("low"), enough("high"))
