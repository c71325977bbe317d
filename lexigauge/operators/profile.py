"""Brand profiles: leaderboards, retrieval, gaps, sources, outreach, and the choice of targets, peers and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.ordering import numbered, reused
from lexigauge.operators.rates import ratio


def _mean(c: Column, n: Column) -> Column:
    """Mean of a column over rows that each stand for ``n``, nulls left out."""
    return F.try_divide(F.sum(c * n).cast("double"), F.sum(F.when(c.isNotNull(), n)).cast("double"))


def leaderboard(panel: DataFrame, times: str | None = None) -> DataFrame:
    """Per category and brand: mention rate without and with search, first place with search, and the rank by it.

    ``times``: a column that says how many candidates a row stands for.
    """
    n = F.col(times) if times else F.lit(1)
    on, off = F.col("condition") == "search_on", F.col("condition") == "search_off"
    rate = lambda c, label: F.round(_mean(F.when(c, F.col(label)), n), 6)
    rows = panel.groupBy("category", "brand").agg(rate(off, "y_mention").alias("mention_off"), rate(on, "y_mention").alias("mention_on"), rate(on, "y_top").alias("top_on"))
    return rows.withColumn("rank_on", F.rank().over(Window.partitionBy("category").orderBy(F.desc("mention_on"))))


def leaders(board: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` brands of a category by mention, then first place, then name."""
    order = Window.partitionBy("category").orderBy(F.desc("mention_on"), F.desc("top_on"), "brand")
    return board.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("category", "brand", "place")


def retrieval_profile(panel: DataFrame, times: str | None = None) -> DataFrame:
    """Per category and brand over answers that searched: presence, results per answer, first ranks, shares of source kinds.

    ``times``: a column that says how many candidates a row stands for.
    """
    n = F.col(times) if times else F.lit(1)
    rows = panel.where("condition = 'search_on'")
    kinds = [c for c in panel.columns if c.startswith("n_") and c != "n_results_mentioning"]
    volume = F.greatest(F.sum(F.col("n_results_mentioning") * n), F.lit(1))
    return rows.groupBy("category", "brand").agg(
        F.round(_mean(F.col("in_search_results"), n), 6).alias("presence"),
        F.round(_mean(F.col("n_results_mentioning"), n), 6).alias("results_per_answer"),
        F.round(_mean((F.col("best_position") == 1).cast("int"), n), 6).alias("rank1_share"),
        *[ratio(F.sum(F.col(k) * n), volume).alias(f"share_{k[2:]}") for k in kinds],
    )


def gaps(profile: DataFrame, board: DataFrame, first: DataFrame) -> DataFrame:
    """Every brand against the mean of its category's leaders (itself left out), metric by metric."""
    metrics = ["presence", "results_per_answer", "rank1_share", "share_editorial", "share_affiliate", "share_forum", "mention_on", "top_on"]
    rows = profile.join(board.select("category", "brand", "mention_on", "top_on"), ["category", "brand"])
    long = rows.unpivot(["category", "brand"], metrics, "metric", "value")
    lead = long.join(first.select("category", F.col("brand")), ["category", "brand"]).select("category", F.col("brand").alias("leader"), "metric", F.col("value").alias("theirs"))
    both = long.join(lead, ["category", "metric"]).where("brand <> leader")
    return both.groupBy("category", "brand", "metric").agg(F.first("value").alias("mine"), F.round(F.avg("theirs"), 6).alias("winners")).withColumn("gap", F.round(F.col("mine") - F.col("winners"), 6))


def brand_sources(evidence: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` hosts per category and brand that speak of it in the most answers.

    Where the evidence has title and link, also those of a host's first page: by position, then answer, then link.
    """
    order = Window.partitionBy("category", "brand").orderBy(F.desc("answers"), "host", "kind")
    page = F.struct("position", "record_id", "link", "title")
    first = [F.min(page)[c].alias(c) for c in ("title", "link")] if {"title", "link"} <= set(evidence.columns) else []
    rows = evidence.groupBy("category", "brand", "host", "kind").agg(F.countDistinct("record_id").alias("answers"), F.min("position").alias("best"), *first)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def outreach(evidence: DataFrame, rivals: int = 2) -> DataFrame:
    """Per category and brand: independent hosts that name ``rivals`` other brands or more, but never this one.

    A host's brands are a set within the category's, so those it lacks are a difference of two small arrays; a result row
    is a gap itself, and no pair of host and brand is made to be thrown away.
    """
    free = F.col("kind").isin("editorial", "forum", "affiliate")
    hosts = evidence.groupBy("category", "host").agg(F.collect_set(F.when(free, F.col("brand"))).alias("named"), F.collect_set("brand").alias("known"))
    brands = evidence.groupBy("category").agg(F.collect_set("brand").alias("brands"))
    apt = hosts.where(F.size("named") >= rivals).join(brands, "category")
    return apt.select("category", F.explode(F.array_except("brands", "known")).alias("brand"), "host", F.size("named").cast("long").alias("named"))


def targets(panel: DataFrame, low: float = 0.05, high: float = 0.40, k: int = 2) -> DataFrame:
    """Brands to test: named in a share between the bounds, of these the ``k`` least retrieved per category."""
    rows = panel.groupBy("category", "brand").agg(F.round(F.avg(F.when(F.col("condition") == "search_off", F.col("y_mention").cast("double"))), 6).alias("relevance"), F.round(F.avg(F.when(F.col("condition") == "search_on", F.col("in_search_results").cast("double"))), 6).alias("presence"))
    order = Window.partitionBy("category").orderBy("presence", "brand")
    return rows.where(F.col("relevance").between(low, high)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def contexts(responses: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per query the answer of lower-median number of results (ties by record_id).

    Answers are counted per number of results, which says where the median lies; only the answers of that number are put
    in order, over many tasks.
    """
    rows = responses.where("condition = 'search_on'").join(volumes, "record_id").select("query_id", "record_id", "n_results")
    by = Window.partitionBy("query_id")
    sizes = rows.groupBy("query_id", "n_results").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(by.orderBy("n_results"))
    at = sizes.select("query_id", "n_results", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.expr("(sum(n) over (partition by query_id) - 1) div 2").alias("middle"))
    at = at.where("before <= middle and middle < upto").select("query_id", "n_results", (F.col("middle") - F.col("before")).alias("place"))
    near = numbered(rows.join(at.drop("place"), ["query_id", "n_results"]), ["query_id"], ["record_id"])
    return near.join(at, ["query_id", "n_results", "place"]).select("query_id", "record_id", "n_results")


def observation_rates(panel: DataFrame, times: str | None = None) -> DataFrame:
    """Per category and brand: mention rates, first rate, presence, upper median of the place among retrieved, queries.

    ``times``: a column that says how many candidates a row stands for.
    """
    n = F.col(times) if times else F.lit(1).cast("long")
    on = F.col("condition") == "search_on"
    labels = ("y_mention", "y_top", "in_search_results")
    # one pass over the candidates: all that follows are sums over counts per query and place
    counts = reused(panel.groupBy("category", "brand", "query_id", on.alias("on"), "best_position").agg(F.sum(n).alias("n"), *[F.sum(x).alias(f"{t}_{c}") for c in labels for t, x in (("s", F.col(c) * n), ("n", F.when(F.col(c).isNotNull(), n)))]))
    rate = lambda c, when: F.round(F.try_divide(F.sum(F.when(when, F.col(f"s_{c}"))).cast("double"), F.sum(F.when(when, F.col(f"n_{c}"))).cast("double")), 6)
    on = F.col("on")
    rows = counts.groupBy("category", "brand").agg(
        rate("y_mention", ~on).alias("mention_off"), rate("y_mention", on).alias("mention_on"), rate("y_top", on).alias("first_on"), rate("in_search_results", on).alias("presence"),
        F.countDistinct("query_id").alias("queries"),
    )
    # the upper median from counts per place: a list of all places would grow with the corpus
    per = counts.where("on and best_position > 0").groupBy("category", "brand", "best_position").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("category", "brand")
    upto = F.sum("n").over(by.orderBy("best_position"))
    at = per.select("category", "brand", "best_position", upto.alias("upto"), F.sum("n").over(by).alias("total"))
    middle = at.where("upto >= total div 2 + 1").groupBy("category", "brand").agg(F.min("best_position").alias("median_position"))
    return rows.join(middle, ["category", "brand"], "left")


def rivals(panel: DataFrame, k: int = 5) -> DataFrame:
    """Per category and brand the ``k`` other brands named most often in the same answers; ties by name."""
    named = panel.where("condition = 'search_on' and y_mention = 1").select("record_id", "category", "brand")
    other = named.select("record_id", F.col("brand").alias("rival"))
    together = named.join(other, "record_id").where("brand <> rival").groupBy("category", "brand", "rival").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("category", "brand").orderBy(F.desc("n"), "rival")
    return together.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lagging(profile: DataFrame, share: float = 0.75) -> DataFrame:
    """Metrics in which a brand has less than ``share`` of the category mean of the others."""
    metrics = ["presence", "results_per_answer", "rank1_share"]
    long = profile.unpivot(["category", "brand"], metrics, "metric", "mine")
    by = Window.partitionBy("category", "metric")
    others = (F.sum("mine").over(by) - F.col("mine")) / (F.count(F.lit(1)).over(by) - 1)
    return long.withColumn("theirs", F.round(others, 6)).where(F.col("mine") < share * F.col("theirs")).select("category", "brand", "metric", "mine", "theirs")


def diagnose(rates: DataFrame) -> DataFrame:
    """What holds a brand back, by floors on presence, place, mentions and first places."""
    kind = (
        F.when(F.col("queries") < 3, "thin")
        .when(F.col("presence") < 0.34, "absent")
        .when(F.col("median_position") > 5, "low_rank")
        .when(F.col("first_on") >= 0.20, "leader")
        .when((F.col("mention_on") >= 0.30) & (F.col("first_on") == 0), "ceiling")
        .otherwise("low_rank")
    )
    return rates.select("category", "brand", "presence", "median_position", "mention_on", "first_on", kind.alias("diagnosis"))


def against_rivals(scored: DataFrame) -> DataFrame:
    """brand, score (mean), rank (ties share the best place), rivals (mean of the other brands' scores).

    One row per brand of the registry meets the windows.
    """
    means = scored.groupBy("brand").agg(F.round(F.avg("score"), 6).alias("score"))
    every = Window.partitionBy()
    others = (F.sum("score").over(every) - F.col("score")) / (F.count(F.lit(1)).over(every) - 1)
    return means.select("brand", "score", F.rank().over(Window.orderBy(F.desc("score"))).alias("rank"), F.round(others, 6).alias("rivals"))


def comparison_set(named: DataFrame, scores: DataFrame, target: str, k: int = 5) -> DataFrame:
    """The brands to compare a target with: its ``k`` most named rivals, or without any the ``k`` best scored ones."""
    best = lambda rows, by: rows.where(F.col("brand") != target).orderBy(F.desc(by), "brand").limit(k).select("brand")
    rivals = best(named, "mentions")
    return best(scores, "score") if rivals.isEmpty() else rivals


def final_ranking(scored: DataFrame) -> DataFrame:
    """record_id, brand, score, rank: candidates of an answer by score, then by name."""
    order = Window.partitionBy("record_id").orderBy(F.desc("score"), "brand")
    return scored.select("record_id", "brand", F.round("score", 6).alias("score"), F.row_number().over(order).alias("rank"))
