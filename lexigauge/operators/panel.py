"""The candidate panel: evidence, priors, features relative to the other candidates of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lexigauge.operators.ordering import looked_up, reused
from lexigauge.operators.rates import small

SMOOTHING = 10


def evidence(responses: DataFrame, found: DataFrame) -> DataFrame:
    """One row per search result of an answer that searched, with a content id."""
    on = responses.where("condition = 'search_on'").select("record_id", "category", "query_id")
    key = F.concat_ws("|", F.col("record_id").cast("string"), F.col("position").cast("string"), "brand", "host")
    return found.join(on, "record_id").select(F.substring(F.sha2(key, 256), 1, 24).alias("source_id"), "record_id", "category", "query_id", "position", "brand", "kind", "host")


def universe(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Brands that are both observed and registered."""
    return mentions.select("brand").intersect(registry.select("brand"))


def smoothed(hits: Column, n: Column, base: Column) -> Column:
    """(hits + 10 base) / (n + 10), and the base where nothing was seen."""
    return F.when(n.isNull() | (n == 0), base).otherwise((hits + SMOOTHING * base) / (n + SMOOTHING))


def priors(panel: DataFrame, by: list[str], label: str, only: str = "true") -> DataFrame:
    """Smoothed rate of ``label`` per ``by`` and brand over rows that meet ``only``; base: the rate per ``by``."""
    rows = panel.where(only)
    base = rows.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("base"))
    own = rows.groupBy(*by, "brand").agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("n"))
    return own.join(base, by).select(*by, "brand", F.round(smoothed(F.col("hits"), F.col("n"), F.col("base")), 6).alias("prior"))


def tallied(rows: DataFrame, brands: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """keys, brand, evidence, m: the panel that ``rows`` (as of ``corpus.folded``) stand for, counted by these columns.

    Every answer has one row of null brand, so it is a candidate of all ``brands``; where it has no row of a brand its
    evidence is zero. Answers are counted per key and those with a row of the brand taken off, so no candidate without
    evidence is made.
    """
    counted = reused(rows.groupBy(*keys, "brand", *evidence).agg(F.count(F.lit(1)).alias("m")))
    own = counted.where("brand is not null")
    answers = counted.where("brand is null").groupBy(*keys).agg(F.sum("m").alias("m")).crossJoin(small(brands.select("brand").distinct()))
    seen = own.select(*keys, (-F.col("m")).alias("m"), "brand")
    rest = answers.unionByName(seen).groupBy(*keys, "brand").agg(F.sum("m").alias("m")).where("m > 0")
    return own.unionByName(rest.select(*keys, "brand", *[F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in evidence], "m"))


def add_priors(panel: DataFrame, train: Column, times: str | None = None) -> DataFrame:
    """``panel`` with prior_top_off, prior_mention_off, prior_top_all and prior_mention_all, fitted on the rows ``train``.

    off: answers without search only; top: decided answers only. A brand without training rows has its category's base
    rate, a category without any has 0, and so has every row where nothing was trained on. The training rows are
    aggregated once by category and brand; base rates are sums of the same sums. ``times``: a column that says how many
    candidates a row stands for.
    """
    n = F.col(times) if times else F.lit(1).cast("long")
    off, decided, zero = F.col("condition") == "search_off", F.col("response_decided") == 1, F.lit(0.0)
    cases = {"prior_top_off": ("y_top", off & decided), "prior_mention_off": ("y_mention", off), "prior_top_all": ("y_top", decided), "prior_mention_all": ("y_mention", F.lit(True))}
    sums = [x for name, (label, only) in cases.items() for x in (F.sum(F.when(only, F.col(label) * n)).alias(f"{name}_h"), F.coalesce(F.sum(F.when(only, n)), F.lit(0).cast("long")).alias(f"{name}_n"))]
    own = panel.where(train).groupBy("category", "brand").agg(*sums)
    own = reused(own)
    base = own.groupBy("category").agg(*[F.try_divide(F.sum(f"{name}_h").cast("double"), F.sum(f"{name}_n").cast("double")).alias(f"{name}_b") for name in cases])
    rows = panel.join(looked_up(own), ["category", "brand"], "left").join(looked_up(base), "category", "left")
    value = lambda name: F.round(F.coalesce(smoothed(F.coalesce(f"{name}_h", F.lit(0)).cast("double"), F.col(f"{name}_n").cast("double"), F.col(f"{name}_b")), zero), 6)
    return rows.select(*[F.col(c) for c in panel.columns], *[value(name).alias(name) for name in cases])


def folds(panel: DataFrame, n: int = 5) -> DataFrame:
    """query_id -> fold: queries of a category in order, dealt round robin."""
    order = Window.partitionBy("category").orderBy(F.md5("query_id"), "query_id")
    return panel.select("category", "query_id").distinct().select("category", "query_id", ((F.row_number().over(order) - 1) % n).cast("int").alias("fold"))


def fold_leaks(rows: DataFrame) -> DataFrame:
    """Queries that are in more than one fold."""
    return rows.groupBy("query_id").agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


def cross_fitted(panel: DataFrame, assigned: DataFrame, label: str = "y_top") -> DataFrame:
    """Nested priors: (outer, inner, category, brand) -> prior from the folds that are neither.

    inner = outer: the prior of held-out rows, from all other folds. Sums per fold are taken once; every combination is a
    difference of such sums, so the panel is aggregated a single time.
    """
    rows = panel.where("response_decided = 1").join(assigned.select("query_id", "fold"), "query_id")
    per = rows.groupBy("fold", "category", "brand").agg(F.sum(label).alias("h"), F.count(F.lit(1)).alias("n"))
    ids = assigned.select("fold").distinct()
    outer = ids.select(F.col("fold").alias("outer_fold")).crossJoin(small(ids.select(F.col("fold").alias("inner_fold"))))
    used = per.crossJoin(small(outer)).where("fold <> outer_fold and fold <> inner_fold")
    own = used.groupBy("outer_fold", "inner_fold", "category", "brand").agg(F.sum("h").alias("hits"), F.sum("n").alias("n"))
    base = used.groupBy("outer_fold", "inner_fold", "category").agg((F.sum("h").cast("double") / F.sum("n")).alias("base"))
    return own.join(base, ["outer_fold", "inner_fold", "category"]).select("outer_fold", "inner_fold", "category", "brand", F.round(smoothed(F.col("hits"), F.col("n"), F.col("base")), 6).alias("prior"))


def panel_filter(panel: DataFrame, target: str = "y_top") -> DataFrame:
    """Rows that count: with search, not of low confidence, and decided where the target is the winner."""
    rows = panel.where("condition = 'search_on' and confidence <> 'low'")
    return rows.where("response_decided = 1") if target == "y_top" else rows


def average_rank_share(value: Column, over: list[str], times: str | None = None) -> Column:
    """Mean rank among ties, over the number of rows: pandas' rank(pct=True) within a group.

    The mean of the first and the last place of the ties; all parts share one window, so a group is sorted once.
    ``times``: a column that says how many rows a row stands for; null where a group stands for none.
    """
    order = Window.partitionBy(*over).orderBy(value)
    if times:
        last = F.sum(times).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.sum(times).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        return F.try_divide((last - ties + 1 + last) / F.lit(2.0), F.sum(times).over(whole(order)).cast("double"))
    last = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(order) + last) / F.lit(2.0) / F.count(F.lit(1)).over(whole(order))


def whole(order: WindowSpec) -> WindowSpec:
    """All rows of a group, in a window that shares the sort of an ordered one."""
    return order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def relative(panel: DataFrame, volumes: DataFrame | None = None, keep: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """Features of a candidate relative to the other candidates of its answer, followed by the columns ``keep``.

    volumes: record_id, n_results; without it the panel has n_results. Ranks among retrieved candidates are 0 for those
    that were not retrieved. All windows partition by record_id, so they share one shuffle, and there are two sorts.
    ``times``: a column that says how many candidates a row stands for.
    """
    rows = (panel if volumes is None else panel.join(volumes, "record_id", "left")).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    volume = F.col("n_results_mentioning")
    answer = whole(Window.partitionBy("record_id").orderBy(volume))
    seen = F.col("in_search_results") == 1
    rank = lambda c: F.when(seen, average_rank_share(c, ["record_id", "in_search_results"], times)).otherwise(F.lit(0.0))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    kinds = [c for c in panel.columns if c.startswith("n_") and c not in ("n_results_mentioning", "n_results")]
    return rows.select(
        "record_id", "brand", "y_top",
        share(volume, F.col("n_results")).alias("volume_share"),
        share(volume, F.max(volume).over(answer)).alias("volume_vs_leader"),
        F.round(average_rank_share(volume, ["record_id"], times), 6).alias("volume_rank_pct"),
        (seen & (F.col("best_position") == F.min(F.when(seen, F.col("best_position"))).over(answer))).cast("long").alias("is_top_retrieved"),
        F.round(rank(-F.col("best_position")), 6).alias("position_rank_pct"),
        *[share(F.col(k), F.greatest(volume, F.lit(1))).alias(f"share_{k[2:]}") for k in kinds],
        *keep,
    )


def negatives(panel: DataFrame, most: int = 7) -> DataFrame:
    """Training rows: all positives, and at most ``most`` negatives per answer by hash order."""
    key = F.md5(F.concat_ws("|", F.col("record_id").cast("string"), "brand"))
    order = Window.partitionBy("record_id", "y_top").orderBy(key, "brand")
    return panel.withColumn("rn", F.row_number().over(order)).where((F.col("y_top") == 1) | (F.col("rn") <= most)).select("record_id", "brand", "y_top")


def comparable(panel: DataFrame) -> DataFrame:
    """Rows with feature_kind: every row for features of presence, retrieved candidates only for those of content."""
    return panel.withColumn("feature_kind", F.lit("presence")).unionByName(panel.where("in_search_results = 1").withColumn("feature_kind", F.lit("content")))


def coverage(panel: DataFrame) -> DataFrame:
    """Per category: answers, those of enough confidence, of these the decided ones, of these those with the winner retrieved."""
    sure = F.col("confidence") != "low"
    decided = sure & (F.col("response_decided") == 1)
    found = decided & (F.col("y_top") == 1) & (F.col("in_search_results") == 1)
    flag = lambda ok, name: F.max(F.coalesce(ok, F.lit(False)).cast("int")).alias(name)
    answers = panel.where("record_id is not null").groupBy("category", "record_id").agg(flag(sure, "confident"), flag(decided, "decided"), flag(found, "winner_retrieved"))
    return answers.groupBy("category").agg(F.count(F.lit(1)).alias("answers"), *[F.sum(c).alias(c) for c in ("confident", "decided", "winner_retrieved")])


def effective_folds(responses: DataFrame, wanted: int) -> DataFrame:
    """Per category: the folds that its queries can fill, ``wanted`` at most and two at least."""
    n = responses.groupBy("category").agg(F.countDistinct("query_id").alias("n"))
    return n.select("category", F.least(F.lit(wanted), "n").cast("long").alias("smallest"), F.greatest(F.lit(2), F.least(F.lit(wanted), "n")).cast("long").alias("folds"))
