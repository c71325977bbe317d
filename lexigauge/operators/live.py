"""The live side: candidates found for a brand, its language next to rivals', outreach, measured recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions import names as nm
from lexigauge.functions.text import LEXICON, snippet_features
from lexigauge.functions.urls import on_platform
from lexigauge.operators.panel import average_rank_share


def language(snippets: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """record_id, brand, n_snippets and the features of a candidate's snippets."""
    return snippets.select("record_id", "brand", "n_snippets", *snippet_features(F.col("snippet"), F.col("n_snippets"), lexicon))


def language_ranks(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """record_id, brand and <feature>_pct: mean rank of each feature among the candidates of an answer that were retrieved,
    over their number; 0 for those that were not."""
    seen = (F.col("n_snippets") > 0).cast("int")
    rows = features.withColumn("_seen", seen)
    pct = lambda c: F.when(F.col("_seen") == 1, average_rank_share(F.col(c), ["record_id", "_seen"])).otherwise(F.lit(0.0))
    return rows.select("record_id", "brand", *[F.round(pct(c), 6).alias(f"{c}_pct") for c in columns])


def encoder_inputs(panel: DataFrame, snippets: DataFrame) -> DataFrame:
    """Every row of a panel with its snippets; the join is 1:1 by (record_id, brand) and must match every row."""
    from lexigauge.operators.checks import matched

    return matched(panel, snippets, ["record_id", "brand"])


MASK = "[BRAND]"


def encoder_texts(panel: DataFrame, queries: DataFrame, snippets: DataFrame, registry: nm.Registry) -> DataFrame:
    """``panel`` with text_a (the query) and text_b (brand and snippets), and text_b_masked, the same without any name.

    ``queries``: record_id, query_text; ``snippets``: record_id, brand, snippet (null: empty). Both variants share rows,
    labels and folds. A row that has not exactly one snippet row is an error, and so is one without its query.
    """
    rows = encoder_inputs(panel, snippets.select("record_id", "brand", F.coalesce("snippet", F.lit("")).alias("snippet")))
    rows = rows.join(queries.select("record_id", F.col("query_text").alias("text_a")), "record_id", "left")
    rows = rows.withColumn("text_a", F.coalesce("text_a", F.raise_error(F.lit("a row has no query")).cast("string")))
    masked = F.concat(F.lit(f"{MASK} : "), nm.blanked(F.col("snippet"), registry))
    return rows.withColumns({"text_b": F.concat(F.col("brand"), F.lit(" : "), F.col("snippet")), "text_b_masked": masked}).drop("snippet")


def with_priors(panel: DataFrame, priors: DataFrame, on: list[str]) -> DataFrame:
    """Panel with the prior of its key (many rows to one); a key without a prior is an error."""
    joined = panel.join(priors.withColumn("_known", F.lit(True)), on, "left")
    return joined.where(F.when(F.col("_known").isNull(), F.raise_error(F.lit("a row has no prior"))).otherwise(F.lit(True))).drop("_known")


def outreach(results: DataFrame, registry: nm.Registry, target: str, stems: dict[str, str], platforms: Sequence[str], by: str, limit: int = 6) -> DataFrame:
    """by, host, rivals, position, rank: pages that name rivals of ``target`` but not itself, on sites that belong to nobody.

    Pages on the target's own site, a brand's site or a platform are left out. A host counts once, by its page with most
    rivals, then the best position; the first ``limit`` hosts per group are returned.
    """
    named = F.array_distinct(nm.names_in(F.col("text"), registry))
    rows = results.select(by, "host", "position", named.alias("named")).where(~F.array_contains("named", F.lit(target)) & (F.size("named") > 0))
    owned = F.exists(F.array(*[F.lit(s) for s in sorted(set(stems.values()))]), lambda s: F.contains(F.coalesce("host", F.lit("")), s))
    rows = rows.where(~owned & ~F.coalesce(on_platform(F.col("host"), platforms), F.lit(False))).withColumn("rivals", F.size("named"))
    once = rows.groupBy(by, "host").agg(F.max("rivals").alias("rivals"), F.min_by("position", F.struct((-F.col("rivals")).alias("r"), F.coalesce("position", F.lit(99)).alias("p"))).alias("position"))
    order = Window.partitionBy(by).orderBy(F.desc("rivals"), F.coalesce("position", F.lit(99)), "host")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def product_links(links: DataFrame, hints: Sequence[tuple[str, int]], by: str, k: int = 3) -> DataFrame:
    """by, url, score, rank: a site's links by the sum of the hints in them, shorter ones first; without a hint none."""
    score = sum((F.when(F.contains(F.lower("url"), F.lit(h)), F.lit(n)).otherwise(F.lit(0)) for h, n in hints), F.lit(0))
    rows = links.select(by, "url").distinct().withColumn("score", score).where("score > 0")
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.length("url"), "url")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_of_each(rows: DataFrame, by: str, key: str, order: str, k: int = 3) -> DataFrame:
    """Rows without repeats of ``key`` within a group (the first in order stays), the first ``k`` of them."""
    once = rows.groupBy(by, key).agg(F.min(order).alias(order))
    place = Window.partitionBy(by).orderBy(order, key)
    return once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def tested(effects: DataFrame, arm: str, base: str) -> DataFrame:
    """effect, low, high and verdict of one tested contrast: a gain or a loss where the interval leaves out zero, else none."""
    rows = effects.where((F.col("arm") == arm) & (F.col("base") == base))
    verdict = F.when(F.col("low") > 0, "gain").when(F.col("high") < 0, "loss").otherwise("no measurable effect")
    return rows.select("scope", "effect", "low", "high", verdict.alias("verdict"))


def recommendations(gaps: DataFrame, verdicts: DataFrame, advice: Sequence[tuple[str, str]], ratio: float = 0.75) -> DataFrame:
    """category, brand, metric, title, mine, winners, verdict: advice for each metric in which a brand has less than
    ``ratio`` of its winners, with what the test of that advice has measured.

    gaps: category, brand, metric, mine, winners; verdicts: metric, verdict.
    """
    titles = F.create_map(*[F.lit(x) for pair in advice for x in pair])
    rows = gaps.where(F.col("mine") < ratio * F.col("winners")).withColumn("title", F.try_element_at(titles, F.col("metric"))).where("title is not null")
    return rows.join(verdicts.select("metric", "verdict"), "metric", "left").select("category", "brand", "metric", "title", "mine", "winners", F.coalesce("verdict", F.lit("not tested")).alias("verdict"))


def grounded(claims: DataFrame, sources: DataFrame, on: str, quote: str, text: str, least: int = 1) -> DataFrame:
    """Claims whose quote, of ``least`` characters or more, stands in the text of their source."""
    both = claims.join(sources.select(on, F.col(text).alias("_text")), on)
    return both.where((F.length(F.trim(quote)) >= least) & F.contains("_text", quote)).drop("_text")


def extracted(names: DataFrame, texts: DataFrame, by: str, labels: Column | None = None, most: int = 25) -> DataFrame:
    """by, name, rank: names found that really occur in the texts of their group, each key once, the first ``most``.

    names: by, name, place; texts: by, text.
    """
    both = names.join(texts, by).where(nm.occurs(F.col("name"), F.col("text")))
    once = both.groupBy(by, nm.comparison_key(F.col("name")).alias("_key")).agg(F.min_by("name", F.struct("place", "name")).alias("name"), F.min("place").alias("place"))
    order = Window.partitionBy(by).orderBy("place", "name")
    return once.select(by, "name", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def normalised_judgements(rows: DataFrame, column: str, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """A struct column (top, mentioned array) with all its names as brand keys."""
    top = nm.brand_key(F.col(f"{column}.top"), aliases)
    named = F.array_distinct(F.transform(F.col(f"{column}.mentioned"), lambda n: nm.brand_key(n, aliases)))
    return rows.withColumn(column, F.col(column).withField("top", top).withField("mentioned", named))


def seen_by(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a table whose keys another one has: models are compared on what both have scored."""
    return rows.join(other.select(*on).distinct(), on, "left_semi")


def live_panel(results: DataFrame, registry: nm.Registry, target: str) -> DataFrame:
    """Candidate rows of a request: per record and brand its results, best position, whether retrieved and whether the target.

    The same columns that models are trained on, from results as they come in; brands that no result names have none.
    """
    hits = results.select("record_id", "position", F.explode(F.array_distinct(nm.names_in(F.col("text"), registry))).alias("brand"))
    found = hits.groupBy("record_id", "brand").agg(F.count(F.lit(1)).alias("n_results_mentioning"), F.min("position").alias("best_position"))
    volumes = results.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_results"))
    grid = volumes.select("record_id", "n_results", F.explode(F.array(*[F.lit(b) for b in sorted({b for b, _ in registry})])).alias("brand"))
    rows = grid.join(found, ["record_id", "brand"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    share = F.round(F.try_divide(zero("n_results_mentioning").cast("double"), F.col("n_results").cast("double")), 6)
    return rows.select("record_id", "brand", "n_results", zero("n_results_mentioning").alias("n_results_mentioning"), F.coalesce("best_position", F.lit(99)).alias("best_position"), F.col("best_position").isNotNull().cast("long").alias("in_search_results"), share.alias("volume_share"), (F.col("brand") == target).cast("long").alias("is_target"))
