"""Rates and distributions over answers: recommendation rates, share of voice, visibility, quality summaries, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ON, OFF = "search_on", "search_off"


def small(dimension: DataFrame, most: int = 100_000) -> DataFrame:
    """A dimension of a cross join, marked for broadcast; it is counted first, and one of over ``most`` rows is an error."""
    if dimension.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of over {most} rows cannot be crossed with other rows")
    return F.broadcast(dimension)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded quotient of doubles; null where the divisor is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def recommendation_rates(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """Per category, condition and brand: how often it is recommended first, over all answers of the segment.

    Answers without a winner stay in the denominator.
    """
    size = answers.groupBy("category", "condition").agg(F.count(F.lit(1)).alias("denominator"))
    wins = answers.where("top is not null").groupBy("category", "condition", F.col("top").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    rows = size.crossJoin(small(brands)).join(wins, ["category", "condition", "brand"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("category", "condition", "brand", n.alias("wins"), "denominator", ratio(n, F.col("denominator")).alias("rate"))


def rate_change(rates: DataFrame) -> DataFrame:
    """Percentage points gained with search, per category and brand."""
    wide = rates.groupBy("category", "brand").pivot("condition", [OFF, ON]).agg(F.first("rate"))
    return wide.select("category", "brand", F.round((F.col(ON) - F.col(OFF)) * 100, 4).alias("points"))


def share_of_voice(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per category, condition and named brand: its share of answers that name it and of answers that it wins."""
    size = answers.groupBy("category", "condition").agg(F.count(F.lit(1)).alias("total"))
    named = answers.join(mentions, "record_id").groupBy("category", "condition", "brand").agg(F.count(F.lit(1)).alias("mentions"), F.sum((F.coalesce(F.col("top"), F.lit("")) == F.col("brand")).cast("int")).alias("wins"))
    return named.join(size, ["category", "condition"]).select("category", "condition", "brand", "mentions", "wins", "total", ratio(F.col("mentions"), F.col("total")).alias("mention_share"), ratio(F.col("wins"), F.col("total")).alias("win_share"))


def share_change(voice: DataFrame) -> DataFrame:
    """Mention shares without and with search side by side (0 where unnamed), and their difference."""
    wide = voice.groupBy("category", "brand").pivot("condition", [OFF, ON]).agg(F.first("mention_share")).na.fill(0.0)
    return wide.select("category", "brand", F.col(OFF).alias("off"), F.col(ON).alias("on"), F.round(F.col(ON) - F.col(OFF), 6).alias("change"))


def visibility(answers: DataFrame, mentions: DataFrame, brand: str) -> DataFrame:
    """Per condition and model: answers, those that name ``brand``, those that it wins, and both rates."""
    named = mentions.where(F.col("brand") == brand).select("record_id", F.lit(1).alias("named"))
    rows = answers.join(named, "record_id", "left").groupBy("condition", "model_id")
    out = rows.agg(F.count(F.lit(1)).alias("responses"), F.coalesce(F.sum("named"), F.lit(0)).alias("mentions"), F.sum((F.coalesce("top", F.lit("")) == brand).cast("int")).alias("wins"))
    return out.select("*", ratio(F.col("mentions"), F.col("responses")).alias("mention_rate"), ratio(F.col("wins"), F.col("responses")).alias("win_rate"))


def top_recommendations(answers: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` brands recommended most often per category; ties go to the smaller name."""
    from pyspark.sql import Window

    order = Window.partitionBy("category").orderBy(F.desc("picks"), "brand")
    counts = answers.where("top is not null").groupBy("category", F.col("top").alias("brand")).agg(F.count(F.lit(1)).alias("picks"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quality_summary(answers: DataFrame) -> DataFrame:
    """One row: rows, distinct and repeated record ids, rows without a winner, queries."""
    return answers.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("record_id").alias("records"),
        (F.count(F.lit(1)) - F.countDistinct("record_id")).alias("repeated"),
        F.count_if(F.col("top").isNull()).alias("undecided"),
        F.countDistinct("query_id").alias("queries"),
    )


def incomplete_cells(answers: DataFrame, least: int) -> DataFrame:
    """Cells (query, model, condition) with fewer than ``least`` repetitions."""
    return answers.groupBy("query_id", "model_id", "condition").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def expected_cells(answers: DataFrame) -> DataFrame:
    """The full factorial of the queries, models and conditions that occur."""
    each = [answers.select(c).distinct() for c in ("query_id", "model_id", "condition")]
    return each[0].crossJoin(small(each[1])).crossJoin(small(each[2]))


def contract(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells that are missing or unexpected, with their side."""
    actual = answers.select("query_id", "model_id", "condition").distinct()
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def plan_summary(answers: DataFrame) -> DataFrame:
    """Counts by each of five dimensions and in total, in one pass of grouping sets."""
    dims = ["category", "query_id", "model_id", "condition", "confidence"]
    sets = [[F.col(d)] for d in dims] + [[]]
    rows = answers.groupingSets(sets, *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims], F.lit("all"))
    return rows.select(name.alias("dimension"), F.coalesce(*dims, F.lit("ALL")).alias("value"), "n")


def findings(rates: DataFrame, specs: DataFrame) -> DataFrame:
    """The rates of given (category, condition, brand) findings, in percent."""
    return rates.join(specs, ["category", "condition", "brand"]).select("category", "condition", "brand", F.col("wins").alias("count"), "denominator", F.round(F.col("rate") * 100, 4).alias("rate_percent"))


def matched_intents(answers: DataFrame, queries: list[str]) -> DataFrame:
    """Per query that both conditions ask: answers of each, and the difference of their shares with a winner in points."""
    on = F.col("condition") == "search_on"
    won = F.col("top").isNotNull().cast("int")
    rows = answers.where(F.col("query_id").isin(queries)).groupBy("query_id").agg(F.count_if(on).alias("en"), F.count_if(~on).alias("tr"), F.avg(F.when(on, won)).alias("a"), F.avg(F.when(~on, won)).alias("b"))
    return rows.where("en > 0 and tr > 0").select("query_id", "en", "tr", F.round(100 * (F.col("a") - F.col("b")), 4).alias("points"))


def market_summary(answers: DataFrame) -> DataFrame:
    """Per category: answers, their conditions as text, share with a single winner, mean number of words.

    ``answers``: category, condition, single (boolean, null counts as no), words (null counts as 0).
    """
    per = answers.groupBy("category", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("single").alias("s"), F.sum(F.coalesce("words", F.lit(0))).alias("w"))
    conditions = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("condition", "n"))), lambda x: F.concat(x["condition"], F.lit("="), x["n"].cast("string"))), ",")
    rows = per.groupBy("category").agg(F.sum("n").alias("answers"), conditions.alias("conditions"), F.sum("s").alias("s"), F.sum("w").alias("w"))
    return rows.select("category", "answers", "conditions", F.round(F.col("s") / F.col("answers"), 4).alias("single_winner_rate"), F.round(F.col("w") / F.col("answers"), 2).alias("mean_words"))
