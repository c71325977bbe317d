"""Concentration and fairness of naming: effective brands, indices, gains of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.rates import ratio


def concentration(panel: DataFrame, k: int = 3) -> DataFrame:
    """Per category, condition and model (ALL: all models): effective number of brands, normalised HHI, top-k share,
    naming events, brands never named, queries with an event. Null without events.

    Grouping sets give both levels in one pass; shares then run over a few dozen brands per scope.
    """
    dims = ["category", "condition", "model_id"]
    every = panel.groupingSets([[F.col(d) for d in [*dims, "brand"]], [F.col(d) for d in ["category", "condition", "brand"]]], *[F.col(d) for d in [*dims, "brand"]])
    events = every.agg(F.sum("y_mention").alias("e")).withColumn("model_id", F.coalesce("model_id", F.lit("ALL")))
    scope = Window.partitionBy(*dims)
    rows = events.select(*dims, "brand", "e", ratio(F.col("e"), F.sum("e").over(scope), 12).alias("s"), F.row_number().over(scope.orderBy(F.desc("e"), "brand")).alias("rn"))
    out = rows.groupBy(*dims).agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), F.sum(F.when(F.col("rn") <= k, F.col("s"))).alias("top"), F.sum("e").alias("events"), F.count(F.lit(1)).alias("brands"), F.count_if(F.col("e") == 0).alias("never_named"))
    floor = 1.0 / F.col("brands")
    return out.select(
        *dims, F.round(1.0 / F.col("hhi"), 6).alias("effective_brands"),
        F.when(F.col("brands") >= 2, F.round((F.col("hhi") - floor) / (1.0 - floor), 6)).alias("normalised_hhi"),
        F.round("top", 6).alias("top_share"), "events", "brands", "never_named",
    )


def retrieval_effect(table: DataFrame) -> DataFrame:
    """Change of the effective number of brands with search, per category and model."""
    wide = table.groupBy("category", "model_id").pivot("condition", ["search_off", "search_on"]).agg(F.first("effective_brands"))
    return wide.select("category", "model_id", F.round(F.col("search_on") - F.col("search_off"), 6).alias("change"))


def rate_matrix(panel: DataFrame, label: str = "y_mention") -> DataFrame:
    """category, condition, query_id, brand, answers, rate: the whole grid of a category's queries and brands; cells without
    an answer have none and a null rate. Brands and queries of a category are bounded sets; the grid is their product."""
    cells = panel.groupBy("category", "condition", "query_id", "brand").agg(F.count(F.lit(1)).alias("answers"), F.avg(F.col(label).cast("double")).alias("rate"))
    brands = panel.groupBy("category").agg(F.collect_set("brand").alias("b"))
    grid = panel.select("category", "condition", "query_id").distinct().join(brands, "category").select("category", "condition", "query_id", F.explode("b").alias("brand"))
    rows = grid.join(cells, ["category", "condition", "query_id", "brand"], "left")
    return rows.select("category", "condition", "query_id", "brand", F.coalesce("answers", F.lit(0).cast("long")).alias("answers"), F.round("rate", 6).alias("rate"))


def query_gains(panel: DataFrame) -> DataFrame:
    """Per category, brand and query: mean mention with search minus without; a missing condition counts as 0."""
    on = F.col("condition") == "search_on"
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("y_mention").cast("double"))), F.lit(0.0))
    return panel.groupBy("category", "brand", "query_id").agg(mean(on).alias("on"), mean(~on).alias("off")).withColumn("gain", F.col("on") - F.col("off"))


def brand_gains(gains: DataFrame) -> DataFrame:
    """Mean over queries, each weighing the same: rates and gain per category and brand."""
    return gains.groupBy("category", "brand").agg(F.round(F.avg("on"), 6).alias("on"), F.round(F.avg("off"), 6).alias("off"), F.round(F.avg("gain"), 6).alias("gain"))


def terciles(table: DataFrame) -> DataFrame:
    """Brands of a category by recognition (rate without search): low, middle, high third; ties by name."""
    by = Window.partitionBy("category")
    share = F.row_number().over(by.orderBy("off", "brand")) * 3
    n = F.count(F.lit(1)).over(by)
    return table.select("category", "brand", F.when(share <= n, "low").when(share <= 2 * n, "middle").otherwise("high").alias("group"))


def origins(registry: DataFrame, origin: DataFrame) -> DataFrame:
    """Brands with a clear origin: brand, group."""
    return registry.join(origin, "brand").where("origin <> 'unclear'").select("brand", F.col("origin").alias("group"))


def group_gains(gains: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Per category, query and group: the mean gain of its brands."""
    return gains.join(groups, on).groupBy("category", "query_id", "group").agg(F.avg("gain").alias("gain"))
