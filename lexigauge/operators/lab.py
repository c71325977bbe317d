"""Effects of the description lab: arms against a base per scope, list positions, fillers, crosses, cost.

Calls: one row per call with category and whatever dimension an effect compares. The scope ALL and every category are one
grouping set, so a table is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.rates import ratio


def scoped(calls: DataFrame) -> DataFrame:
    """Every call twice: with its category as scope, and with ALL."""
    return calls.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("category"))))


def arm_effects(calls: DataFrame, arm: str, base: Column, metrics: tuple[str, ...] = ("first", "mentioned")) -> DataFrame:
    """scope, arm, n, n_base and per metric its rate and its difference to the calls where ``base`` holds."""
    rows = scoped(calls)
    means = [F.avg(m).alias(m) for m in metrics]
    own = rows.groupBy("scope", F.col(arm).cast("string").alias("arm")).agg(F.count(F.lit(1)).alias("n"), *means)
    ref = rows.where(base).groupBy("scope").agg(F.count(F.lit(1)).alias("n_base"), *[F.avg(m).alias(f"_{m}") for m in metrics])
    out = own.join(F.broadcast(ref), "scope", "left")  # one row per scope
    each = [x for m in metrics for x in (F.round(m, 6).alias(f"{m}_rate"), F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"{m}_effect"))]
    return out.select("scope", "arm", "n", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), *each)


def identity_effects(calls: DataFrame, base: str) -> DataFrame:
    """Calls with the control text: each identity against the base identity."""
    return arm_effects(calls.where("variant = 'control'"), "identity", F.col("identity") == base)


def content_effects(calls: DataFrame, identity: str) -> DataFrame:
    """Calls of one identity: each text variant against the control text."""
    return arm_effects(calls.where(F.col("identity") == identity), "variant", F.col("variant") == "control")


def position_effects(calls: DataFrame, base: int = 5) -> DataFrame:
    """All calls by list position of the target, against the last position."""
    return arm_effects(calls, "position", F.col("position") == base)


def pick_share(calls: DataFrame, positions: int = 5) -> DataFrame:
    """scope, position, n, share: where in the list the picked card stood, over all calls that picked one."""
    rows = scoped(calls.where("picked_position is not null"))
    every = F.explode(F.sequence(F.lit(1), F.lit(positions))).alias("position")
    found = rows.groupBy("scope", F.col("picked_position").cast("int").alias("position")).agg(F.count(F.lit(1)).alias("hits"))
    grid = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).select("scope", "n", every)
    return grid.join(found, ["scope", "position"], "left").select("scope", "position", "n", ratio(F.coalesce("hits", F.lit(0).cast("long")), F.col("n")).alias("share"))


def filler_contrast(fillers: DataFrame, cards: DataFrame) -> DataFrame:
    """sentence, n_filler, n_full, filler_share, full_share, difference: wins of a sentence among fillers and among rivals."""
    one = lambda rows, name: rows.groupBy("sentence").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.avg("won").alias(name))
    rows = one(fillers, "filler").join(one(cards, "full"), "sentence")
    return rows.select("sentence", "n_filler", "n_full", F.round("filler", 6).alias("filler_share"), F.round("full", 6).alias("full_share"), F.round(F.col("filler") - F.col("full"), 6).alias("difference"))


def cross_shares(cards: DataFrame) -> DataFrame:
    """sentence, brand, appearances, wins, share, and the share of the sentence over all brands."""
    cells = cards.groupBy("sentence", "brand").agg(F.count(F.lit(1)).alias("appearances"), F.sum("won").alias("wins"))
    total = cells.groupBy("sentence").agg(ratio(F.sum("wins"), F.sum("appearances")).alias("overall"))
    return cells.join(total, "sentence").select("sentence", "brand", "appearances", "wins", ratio(F.col("wins"), F.col("appearances")).alias("share"), "overall")


def cost_line(calls: DataFrame, key: str = "call_id") -> DataFrame:
    """Per model: distinct calls and their mean tokens in and out; a call that several arms share counts once."""
    once = calls.groupBy("model_id", key).agg(F.max("tokens_in").alias("i"), F.max("tokens_out").alias("o"))
    return once.groupBy("model_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("i"), 6).alias("mean_in"), F.round(F.avg("o"), 6).alias("mean_out"))


def completed(calls: DataFrame) -> DataFrame:
    """Per model and status: calls and their tokens, with all statuses as ALL."""
    sets = calls.groupingSets([[F.col("model_id"), F.col("status")], [F.col("model_id")]], F.col("model_id"), F.col("status"))
    out = sets.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return out.select("model_id", F.coalesce("status", F.lit("ALL")).alias("status"), "calls", "tokens_in", "tokens_out")
