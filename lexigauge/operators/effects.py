"""Effects within answers, paired contrasts between arms, and cluster bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.ordering import reused
from lexigauge.operators.rates import ratio


def draw(seed: int, n: Column) -> Column:
    """A number in [0, n) for each (draw, slot), the same on every engine: from the MD5 of seed, draw and slot."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def bootstrap_ratio(blocks: DataFrame, by: list[str], draws: int = 400, seed: int = 42) -> DataFrame:
    """Percentile interval of sum(a) / sum(b) when whole blocks are drawn with replacement.

    blocks: ``by``, an id column ``query_id``, sums a and b per block. The corpus is aggregated to blocks first; draws
    then multiply the number of blocks only. Blocks are numbered per group; a draw takes as many as there are. They are
    read several times, so they are computed once.
    """
    blocks = reused(blocks)
    group = Window.partitionBy(*by)
    numbered = blocks.select(*by, "a", "b", (F.row_number().over(group.orderBy("query_id")) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(group).alias("n"))
    spark = blocks.sparkSession
    times = F.broadcast(spark.range(draws).withColumnRenamed("id", "draw"))
    slots = numbered.select(*by, F.col("k").alias("slot"), "n").crossJoin(times).select(*by, "draw", draw(seed, F.col("n")).alias("k"))
    sums = slots.join(numbered.select(*by, "k", "a", "b"), [*by, "k"]).groupBy(*by, "draw").agg(F.round(F.try_divide(F.sum("a"), F.sum("b")), 9).alias("v"))
    point = blocks.groupBy(*by).agg(F.round(F.try_divide(F.sum("a"), F.sum("b")), 6).alias("estimate"))
    ends = sums.groupBy(*by).agg(F.round(F.percentile("v", 0.025), 6).alias("low"), F.round(F.percentile("v", 0.975), 6).alias("high"))
    return point.join(ends, by)


def concordance(panel: DataFrame, feature: str, stratum: str | None = None, times: str | None = None) -> DataFrame:
    """Per category and query: concordant, discordant and compared pairs of winner and loser within answers.

    Counted by windows over the answer's candidates instead of a self-join: each winner sees how many losers lie at or
    below its value. With ``stratum`` only pairs of equal stratum are compared. ``times``: a column that says how many losers a row stands for.
    """
    over = ["record_id", *([stratum] if stratum else [])]
    loser = (1 - F.col("y_top")) * (F.col(times) if times else 1)
    by = Window.partitionBy(*over).orderBy(feature)
    upto = F.sum(loser).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal, total = F.sum(loser).over(by.rangeBetween(Window.currentRow, Window.currentRow)), F.sum(loser).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = panel.select("category", "query_id", "y_top", upto.alias("upto"), equal.alias("equal"), total.alias("total")).where("y_top = 1")
    return rows.groupBy("category", "query_id").agg(F.sum(F.col("upto") - F.col("equal")).alias("concordant"), F.sum(F.col("total") - F.col("upto")).alias("discordant"), F.sum("total").alias("compared"))


def concordances(panel: DataFrame, features: list[str], times: str | None = None) -> DataFrame:
    """signal and ``concordance`` of each feature, from one pass over the panel."""
    loser = (1 - F.col("y_top")) * (F.col(times) if times else 1)
    answer = Window.partitionBy("record_id")
    counts = []
    for f in features:
        by = answer.orderBy(f)
        upto, equal = (F.sum(loser).over(by.rangeBetween(a, Window.currentRow)) for a in (Window.unboundedPreceding, Window.currentRow))
        counts.append(F.struct(F.lit(f).alias("signal"), upto.alias("upto"), equal.alias("equal"), F.sum(loser).over(answer).alias("total")))
    rows = panel.select("category", "query_id", "y_top", *[c.alias(f"_c{i}") for i, c in enumerate(counts)]).where("y_top = 1")
    rows = rows.select("category", "query_id", F.inline(F.array(*[F.col(f"_c{i}") for i in range(len(features))])))
    return rows.groupBy("signal", "category", "query_id").agg(F.sum(F.col("upto") - F.col("equal")).alias("concordant"), F.sum(F.col("total") - F.col("upto")).alias("discordant"), F.sum("total").alias("compared"))


def effect(blocks: DataFrame, sign: int = 1) -> DataFrame:
    """Rank-biserial effect per category from its query blocks; blocks without a comparison are dropped."""
    rows = blocks.where("compared > 0").groupBy("category").agg(F.sum("concordant").alias("c"), F.sum("discordant").alias("d"), F.sum("compared").alias("comparisons"), F.count(F.lit(1)).alias("queries"))
    return rows.select("category", F.round(sign * (F.col("c") - F.col("d")).cast("double") / F.col("comparisons"), 6).alias("effect"), "comparisons", "queries")


def direction(intervals: DataFrame) -> DataFrame:
    """n/a under five queries, else up, down or flat by where the interval lies."""
    kind = F.when(F.col("queries") < 5, "n/a").when(F.col("low") > 0, "up").when(F.col("high") < 0, "down").otherwise("flat")
    return intervals.withColumn("direction", kind)


def stability(directions: DataFrame) -> DataFrame:
    """Per signal over categories: conflicting, strong (4 or more and two thirds agree), moderate (2 or more), weak."""
    rows = directions.groupBy("signal").agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"), F.count_if(F.col("direction") != "n/a").alias("known"))
    most = F.greatest("up", "down")
    kind = F.when((F.col("up") > 0) & (F.col("down") > 0), "conflicting").when((most >= 4) & (3 * most >= 2 * F.col("known")), "strong").when(most >= 2, "moderate").otherwise("weak")
    return rows.select("signal", "up", "down", "known", kind.alias("stability"))


def arm_contrast(outcomes: DataFrame, base: str) -> DataFrame:
    """Per scope (ALL and each category) and arm: mean paired difference to ``base`` over cells that have both.

    outcomes: category, query_id, target, arm, value. Cells are (category, query, target).
    """
    cells = outcomes.groupBy("category", "query_id", "target", "arm").agg(F.avg("value").alias("v"))
    own, ref = cells.where(F.col("arm") != base), cells.where(F.col("arm") == base).select("category", "query_id", "target", F.col("v").alias("b"))
    rows = own.join(ref, ["category", "query_id", "target"], "left")
    sets = rows.groupingSets([[F.col("category"), F.col("arm")], [F.col("arm")]], F.col("category"), F.col("arm"))
    out = sets.agg(F.avg("v").alias("arm_rate"), F.avg("b").alias("baseline_rate"), F.avg(F.col("v") - F.col("b")).alias("effect"), F.count("b").alias("cells"))
    return out.select(F.coalesce("category", F.lit("ALL")).alias("scope"), "arm", F.round("arm_rate", 6).alias("arm_rate"), F.round("baseline_rate", 6).alias("baseline_rate"), F.round("effect", 6).alias("effect"), "cells")


def contrast_blocks(outcomes: DataFrame, base: str) -> DataFrame:
    """Paired differences as bootstrap blocks: arm, query_id (cell), a (difference), b (1)."""
    cells = outcomes.groupBy("category", "query_id", "target", "arm").agg(F.avg("value").alias("v"))
    ref = cells.where(F.col("arm") == base).select("category", "query_id", "target", F.col("v").alias("base"))
    rows = cells.where(F.col("arm") != base).join(ref, ["category", "query_id", "target"])
    return rows.select("arm", F.concat_ws("|", "category", "query_id", "target").alias("query_id"), F.round(F.col("v") - F.col("base"), 9).alias("a"), F.lit(1.0).alias("b"))


def win_shares(cards: DataFrame) -> DataFrame:
    """Per sentence: appearances, wins and their share. cards: call, sentence, won (0 or 1)."""
    rows = cards.groupBy("sentence").agg(F.count(F.lit(1)).alias("appearances"), F.sum("won").alias("wins"))
    return rows.select("sentence", "appearances", "wins", ratio(F.col("wins"), F.col("appearances")).alias("share"))


def paired_delta(a: DataFrame, b: DataFrame, metric: str, by: str = "category") -> DataFrame:
    """Difference of one metric between two scorings of the same rows."""
    return a.join(b.withColumnRenamed(metric, "other"), by).select(by, F.round(F.col(metric) - F.col("other"), 6).alias("delta"))
