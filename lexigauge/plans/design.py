"""Experiment designs as relations: factorial cells, tournaments, arms with an inserted page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.rates import small


def cells(queries: DataFrame, models: DataFrame, conditions: DataFrame, runs: int) -> DataFrame:
    """The full factorial with a cell id model_condition_query_run."""
    spark = queries.sparkSession
    reps = spark.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
    rows = queries.crossJoin(small(models)).crossJoin(small(conditions)).crossJoin(F.broadcast(reps))
    return rows.select("query_id", "model_id", "condition", "run", F.concat_ws("_", "model_id", "condition", "query_id", F.lpad(F.col("run").cast("string"), 3, "0")).alias("cell_id"))


def tournament(groups: DataFrame, sentences: int = 13, brands: int = 5, steps: int = 6) -> DataFrame:
    """Cyclic tournament per group: at step s and round i, brand (slot+i+s) mod brands shows sentence (i+slot*s) mod sentences."""
    spark = groups.sparkSession
    n = lambda k, name, low=0: F.broadcast(spark.range(low, low + k).select(F.col("id").cast("int").alias(name)))
    rows = groups.crossJoin(n(steps, "step", 1)).crossJoin(n(sentences, "round")).crossJoin(n(brands, "slot"))
    return rows.select("*", ((F.col("slot") + F.col("round") + F.col("step")) % brands).alias("brand"), ((F.col("round") + F.col("slot") * F.col("step")) % sentences).alias("sentence"))


def insert_page(found: DataFrame, rank: int) -> DataFrame:
    """Result lists with one more page at ``rank``; later results move down by one."""
    moved = found.select("record_id", F.when(F.col("position") >= rank, F.col("position") + 1).otherwise(F.col("position")).alias("position"), "host")
    new = found.groupBy("record_id").agg(F.least(F.lit(rank), F.max("position") + 1).alias("position")).withColumn("host", F.lit("inserted.example.com"))
    return moved.unionByName(new.select("record_id", "position", "host"))


def card_position(calls: DataFrame, brands: int = 5) -> DataFrame:
    """Balanced position of a card: (repetition + hash of the cell) mod brands + 1."""
    offset = F.conv(F.substring(F.sha2("cell_id", 256), 1, 8), 16, 10).cast("long") % brands
    return calls.select("cell_id", "run", ((F.col("run") + offset) % brands + 1).alias("position"))


def pilot(responses: DataFrame) -> DataFrame:
    """category, query_id, model_id, condition, cell_id: the first query of each category in every cell, run once."""
    first = responses.groupBy("category").agg(F.min("query_id").alias("query_id"))
    models, conditions = responses.select("model_id").distinct(), responses.select("condition").distinct()
    rows = first.crossJoin(small(models)).crossJoin(small(conditions))  # a handful of models and conditions
    return rows.select("category", "query_id", "model_id", "condition", F.concat_ws("_", "model_id", "condition", "query_id", F.lit("001")).alias("cell_id"))


def jobs(queries: DataFrame, targets: list[str], arms: list[str], repetitions: int) -> DataFrame:
    """query_id, arm, target, rep, job_id; the control's job id leaves the target out, so that its answer is made once."""
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = queries.select("query_id", each(targets).alias("target")).select("*", each(arms).alias("arm")).select("*", each(list(range(1, repetitions + 1))).alias("rep"))
    rep = F.col("rep").cast("string")
    own = F.when(F.col("arm") == "control", F.concat_ws("|", "query_id", "arm", rep)).otherwise(F.concat_ws("|", "query_id", "target", "arm", rep))
    return rows.select("query_id", "arm", "target", "rep", own.alias("job_id"))


def second_round(groups: DataFrame, sentences: int, crossed: int) -> DataFrame:
    """category, wave, kind, sentence, other, place: each sentence against a distant filler, then the best ones crossed."""
    from pyspark.sql import Window

    number = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    filler = groups.select("category", number(sentences, "sentence")).select("category", F.lit(1).alias("wave"), F.lit("filler").alias("kind"), "sentence", ((F.col("sentence") + sentences // 2) % sentences).alias("other"))
    cross = groups.select("category", number(crossed, "sentence")).select("*", number(crossed, "other")).where("sentence < other").select("category", F.lit(2).alias("wave"), F.lit("cross").alias("kind"), "sentence", "other")
    order = Window.partitionBy("category").orderBy("wave", "kind", "sentence", "other")
    return filler.unionByName(cross).withColumn("place", F.row_number().over(order))


def comparison_page(found: DataFrame, rank: int) -> DataFrame:
    """record_id, position, text: the results before ``rank`` as lines, and at ``rank`` a page that names their brands in order."""
    before = found.where(F.col("position") < rank)
    line = F.format_string("Result %d: %s (%s)", "position", "brand", "kind")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "brand"))), lambda x: x["brand"]), ", ")
    page = before.groupBy("record_id").agg(F.concat(F.lit("Comparison of "), names, F.lit(".")).alias("text"))
    return before.select("record_id", "position", line.alias("text")).unionByName(page.select("record_id", F.lit(rank).alias("position"), "text"))


#: Arms of an intervention: the ranks at which a page is put into the list of results, one after another (fixed values).
ARMS = {"control": (), "neutral_p1": (1,), "superlative_p5": (5,), "neutral_p5": (5,), "neutral_p5_p8": (5, 8)}


def arm_lists(found: DataFrame, arms: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """record_id, arm, position, host: the results of every answer as each arm shows them, numbered anew.

    A page goes to its rank, or behind a shorter list; results at and below it move down. A list is bounded by what one
    answer retrieves.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("record_id").orderBy("position")
    base = found.select("record_id", F.row_number().over(order).alias("position"), "host")
    parts = []
    for arm, ranks in (arms or ARMS).items():
        rows = base
        for rank in ranks:
            rows = insert_page(rows, rank)
        parts.append(rows.withColumn("arm", F.lit(arm)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("record_id", "arm", "position", "host")


IDENTITIES = ("incumbent", "small", "fictional")


def lab_cells(categories: DataFrame, variants: list[str]) -> DataFrame:
    """category, block, identity, variant: every identity with the control text, then the fictional one with each variant."""
    one = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    own = categories.select("category", F.lit("identity").alias("block"), one(IDENTITIES, "identity")).withColumn("variant", F.lit("control"))
    text = categories.select("category", F.lit("content").alias("block"), F.lit("fictional").alias("identity"), one(variants, "variant"))
    return own.unionByName(text)


def lab_cards(cells_: DataFrame, competitors: DataFrame, repetitions: int, per: int = 4) -> DataFrame:
    """job_id, category, identity, variant, rep, position, brand (null: the target): the cards of every call in order.

    ``competitors``: category, brand; the first ``per`` of a category by name are shown. They are shuffled by a hash of call
    and brand; the target's card stands at every position once in ``per`` + 1 repetitions, from an offset by cell.
    """
    from pyspark.sql import Window

    name = F.concat_ws("__", "category", "identity", "variant")
    offset = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    calls = cells_.select("category", "identity", "variant", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    calls = calls.select("*", F.concat(name, F.lit("__r"), F.col("rep").cast("string")).alias("job_id"), ((F.col("rep") + offset) % (per + 1) + 1).cast("int").alias("target_at"))
    first = Window.partitionBy("category").orderBy("brand")
    shown = competitors.select("category", "brand").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per).drop("_n")
    order = Window.partitionBy("job_id").orderBy(F.md5(F.concat_ws("|", "job_id", "brand")), "brand")
    others = calls.join(shown, "category").withColumn("place", F.row_number().over(order))
    others = others.withColumn("position", F.col("place") + F.when(F.col("place") >= F.col("target_at"), 1).otherwise(0))
    target = calls.select("*", F.lit(None).cast("string").alias("brand"), F.col("target_at").alias("position"))
    keys = ["job_id", "category", "identity", "variant", "rep", "position", "brand"]
    return others.select(*keys).unionByName(target.select(*keys))
