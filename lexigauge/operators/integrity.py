"""Provenance and state: content hashes, receipts, completeness, currency of judgements, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.ordering import numbered


def canonical(*columns: str) -> Column:
    """A row as text: its values by name order, each behind its length, so that no two rows are alike; a null has none."""
    one = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    return F.concat_ws("|", *[one(F.col(c).cast("string")) for c in sorted(columns)])


def content_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the SHA-256 of its canonical row."""
    return rows.select(key, F.sha2(canonical(*columns), 256).alias("content_hash"))


def table_hash(hashes: DataFrame, by: str) -> DataFrame:
    """Order-insensitive hash per group: SHA-256 over the number of rows and, for four parts of the row hashes, their
    exclusive or and their sum. Everything is combined in the map tasks, so a group of any size costs one row a task."""
    parts = [F.conv(F.substring("content_hash", 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]
    sums = [x for p in parts for x in (F.bit_xor(p).cast("string"), F.sum(p.cast("decimal(38,0)")).cast("string"))]
    return hashes.groupBy(by).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("table_hash"))


def status_summary(records: DataFrame) -> DataFrame:
    """Newest record per key, then counts by status. records: key, status, at, id.

    Keys are reduced to counts per status and their newest status in the map tasks; no key's records meet in one task.
    """
    per = records.groupBy("key", "status").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "id")).alias("last"))
    newest = per.groupBy("key").agg(F.max_by("status", "last").alias("status"))
    current = newest.groupBy("status").agg(F.count(F.lit(1)).alias("current"))
    total = per.groupBy("status").agg(F.sum("n").alias("n"))
    kept = F.coalesce("current", F.lit(0).cast("long"))
    return total.join(current, "status", "left").select("status", kept.alias("current"), (F.col("n") - kept).alias("superseded"))


def receipts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """State of every step: done, exhausted after ``most`` attempts without success, or open."""
    rows = attempts.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.max((F.col("status") == "ok").cast("int")).alias("ok"))
    return rows.select("key", "attempts", F.when(F.col("ok") == 1, "done").when(F.col("attempts") >= most, "exhausted").otherwise("open").alias("state"))


def still_open(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned keys without a completed record."""
    return planned.select(key).distinct().join(done.select(key), key, "left_anti")


def judgement_currency(judgements: DataFrame, contents: DataFrame) -> DataFrame:
    """current, stale or missing per key: the judged hash against that of today's content."""
    rows = contents.join(judgements.select("key", F.col("content_hash").alias("judged")), "key", "left")
    state = F.when(F.col("judged").isNull(), "missing").when(F.col("judged") == F.col("content_hash"), "current").otherwise("stale")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def breaker(calls: DataFrame, run: int = 5) -> DataFrame:
    """Longest run of consecutive failures per group, and whether it reaches ``run``. calls: key, failed, at, id.

    Runs are islands: a failure's number among all calls of its key, less that among its failures, is constant within one.
    Both numbers come from global orders, so the calls of one key are spread over tasks; islands are counted map-side.
    """
    rows = numbered(calls.select("key", "failed", "at", "id"), ["key"], ["at", "id"], "all")
    failures = numbered(rows.where("failed = 1"), ["key"], ["all"], "own")
    runs = failures.groupBy("key", (F.col("all") - F.col("own")).alias("island")).agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("key").agg(F.max("n").alias("longest"))
    every = calls.select("key").distinct().join(longest, "key", "left")
    return every.select("key", F.coalesce("longest", F.lit(0).cast("long")).alias("longest")).withColumn("open", F.col("longest") >= run)


#: Answers of a service after which a model is not asked again (fixed values).
DISABLING = (401, 402, 403, 404, 410, 429)


def disabling(code: Column, transport: Column, quota: Column) -> Column:
    """Whether a failure takes its model out: no connection, no quota left, or a code that a further call would get too."""
    no = F.lit(False)
    return F.coalesce(transport, no) | F.coalesce(quota, no) | F.coalesce(code.isin(*DISABLING), no)


def disabled(calls: DataFrame) -> DataFrame:
    """model, trigger (id), at, failures, skipped: models that a failure has taken out, and the calls that came after.

    ``calls``: model, id, at, failed, disables (whether its failure takes the model out). Ties of time go by id. The first
    such failure is found by a map-side minimum; what comes after is counted against it.
    """
    first = calls.where("failed and disables").groupBy("model").agg(F.min(F.struct("at", "id")).alias("first"))
    both = calls.join(first, "model")
    after = F.struct("at", "id") > F.col("first")
    return both.groupBy("model", "first").agg(F.count_if(F.col("failed") & ~after).alias("failures"), F.count_if(after).alias("skipped")).select("model", F.col("first.id").alias("trigger"), F.col("first.at").alias("at"), "failures", "skipped")


def json_fields(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """JSON text flattened to one column per field, named column__field; text that was encoded twice is decoded twice."""
    plain = F.when(F.substring(column, 1, 1) == '"', F.get_json_object(F.concat(F.lit('{"x":'), column, F.lit("}")), "$.x")).otherwise(F.col(column))
    return rows.select("*", *[F.get_json_object(plain, f"$.{f}").alias(f"{column}__{f}") for f in fields])


def plan_status(answers: DataFrame, planned: DataFrame, by: str, complete: Column) -> DataFrame:
    """Per group: answers, complete ones, planned ones that remain, and answers that no plan asked for."""
    rows = answers.withColumn("_c", complete).join(planned.select("record_id").distinct().withColumn("_p", F.lit(True)), "record_id", "left")
    there = F.col("_p").isNotNull()
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("answers"), F.count_if("_c").alias("complete"), F.count_if(~F.col("_c") & there).alias("remaining"), F.count_if(~there).alias("unplanned"))


def cache_key(query: Column, *parameters: Column) -> Column:
    """24 hex digits of the SHA-256 of a normalised query and its parameters."""
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(query)), *parameters), 256), 1, 24)
