"""Global orders without gathering a group: numbers, running counts and average ranks by range partitions with offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reused(rows: DataFrame) -> DataFrame:
    """``rows`` computed once for several reads.

    In the session's checkpoint folder where it has one, as Parquet: columns of few values take a few bits there, where a
    checkpoint writes whole rows. Else in its cache.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        return rows.persist()
    path = f"{base.rstrip('/')}/lexigauge/reused-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of a table of groups that a join may broadcast.
BROADCAST_GROUPS = 100_000


def looked_up(groups: DataFrame) -> DataFrame:
    """A table of groups for a join with all their rows: computed once, and broadcast up to BROADCAST_GROUPS rows."""
    groups = reused(groups)
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with name long: 0, 1, ... within each group, in the given order.

    Rows are range-partitioned by group and order, so a large group is sorted by many tasks; a partition numbers its own
    rows, and what lies before it in the group is the sum of a few counts per partition. Ties need a last column that
    tells them apart. The columns ``by`` hold no nulls.
    """
    sliced = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    sliced = reused(sliced.withColumn("_slice", F.shiftright("_at", 33)))  # the upper bits name the partition; from here on they are fixed
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_slice", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return sliced.join(starts, [*by, "_slice"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_slice", "_shift")


def counted_before(rows: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """by, value, n, below: rows per distinct value, and rows of the group with smaller values.

    ``times``: a column that says how many rows a row stands for.
    """
    steps = rows.groupBy(*by, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    sliced = reused(steps.repartitionByRange(*by, value).withColumn("_slice", F.spark_partition_id()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = lambda *over: Window.partitionBy(*by, *over).rowsBetween(Window.unboundedPreceding, -1)
    total = sliced.groupBy(*by, "_slice").agg(F.sum("n").alias("_n"))
    offsets = total.select(*by, "_slice", zero(F.sum("_n").over(earlier().orderBy("_slice"))).alias("_below"))
    inside = sliced.select(*by, "_slice", value, "n", zero(F.sum("n").over(earlier("_slice").orderBy(value))).alias("_inside"))
    return inside.join(offsets, [*by, "_slice"]).select(*by, value, "n", (F.col("_inside") + F.col("_below")).alias("below"))


def rank_correlation(rows: DataFrame, by: list[str], a: str, b: str, times: str | None = None) -> DataFrame:
    """by, n, correlation: Spearman's rank correlation with average ranks for ties; null where either value is constant.

    Equal pairs of values are counted first, in the only pass over the rows; both ranks are joined to the distinct pairs.
    Rows with a null value are left out. ``times``: a column that says how many rows a row stands for.
    """
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counted = reused(known.groupBy(*by, a, b).agg((F.sum(times) if times else F.count(F.lit(1))).alias("m")))
    cells = counted
    for value, rank in ((a, "_x"), (b, "_y")):
        places = counted_before(counted, by, value, "m").select(*by, value, (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias(rank))
        cells = cells.join(places, [*by, value])
    m, x, y = F.col("m"), F.col("_x"), F.col("_y")
    sums = cells.groupBy(*by).agg(F.sum("m").alias("n"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("xx"), F.sum(m * y * y).alias("yy"), F.sum(m * x * y).alias("xy"))
    n = F.col("n").cast("double")
    spread = F.sqrt((F.col("xx") - F.col("sx") * F.col("sx") / n) * (F.col("yy") - F.col("sy") * F.col("sy") / n))
    return sums.select(*by, "n", F.when(spread > 1e-9, F.round((F.col("xy") - F.col("sx") * F.col("sy") / n) / spread, 6)).alias("correlation"))
