"""Receipts: an append-only log of requests and their results, written by streams without harm from repeats.

Every batch of a stream has a folder of its own in the log. A batch that is delivered again writes the same rows to the
same folder, and looks only at earlier batches for requests that are answered already, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators.integrity import canonical

LOG = "request_hash string, request string, result string, result_hash string, status string, at timestamp, batch long"


def request_hash(*columns: str) -> Column:
    """SHA-256 of a request's fields, by name order, nulls told apart."""
    return F.sha2(canonical(*columns), 256)


def receipts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """request_hash, request, result, result_hash, status, at of finished calls: ``rows`` with ``columns``, result, status, at."""
    return rows.select(request_hash(*columns).alias("request_hash"), canonical(*columns).alias("request"), "result", F.sha2("result", 256).alias("result_hash"), "status", F.col("at").cast("timestamp").alias("at"))


def record(done: DataFrame, path: str, batch: int) -> None:
    """Write a batch of receipts to the log at ``path``, over what an earlier delivery of the same batch has left there."""
    done.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def log(spark: SparkSession, path: str) -> DataFrame:
    """All receipts with their batch; an empty table where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException:  # the folder is not there before the first batch
        return spark.createDataFrame([], LOG)


def sound(receipts_: DataFrame) -> Column:
    """Whether a receipt's result is the one that was recorded."""
    return F.sha2(receipts_["result"], 256).eqNullSafe(receipts_["result_hash"])


def tampered(receipts_: DataFrame) -> DataFrame:
    """request_hash, at, fault: receipts whose result or request is not the one that was recorded."""
    request = F.sha2("request", 256) == F.col("request_hash")
    fault = F.when(~F.coalesce(request, F.lit(False)), "request").when(~sound(receipts_), "result")
    return receipts_.select("request_hash", "at", fault.alias("fault")).where("fault is not null")


def current(receipts_: DataFrame, most: int = 3) -> DataFrame:
    """request_hash, attempts, result, state: the newest sound result of every request.

    done where there is one, exhausted after ``most`` attempts without, else open. One aggregation with map-side
    combination; receipts of one request never meet in a list.
    """
    fine = sound(receipts_) & (F.col("status") == "ok")
    rows = receipts_.groupBy("request_hash").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("result", F.when(fine, F.struct("at", "result"))).alias("result"), F.count_if(fine).alias("fine"))
    state = F.when(F.col("fine") > 0, "done").when(F.col("attempts") >= most, "exhausted").otherwise("open")
    return rows.select("request_hash", "attempts", F.when(F.col("fine") > 0, F.col("result")).alias("result"), state.alias("state"))


def unanswered(requests: DataFrame, columns: list[str], receipts_: DataFrame, most: int = 3) -> DataFrame:
    """The distinct requests without a sound result and with attempts left; further columns of a request follow its first row."""
    closed = current(receipts_, most).where("state <> 'open'").select("request_hash")
    named = requests.withColumn("request_hash", request_hash(*columns)).dropDuplicates(["request_hash"])
    return named.join(closed, "request_hash", "left_anti")


def answering(requests: DataFrame, columns: list[str], path: str, answer: Callable[[DataFrame], DataFrame], checkpoint: str, most: int = 3):  # noqa: ANN201
    """A stream of requests answered through the log at ``path``: ``answer`` adds result, status and at to open ones only."""

    def batch(rows: DataFrame, number: int) -> None:
        known = log(rows.sparkSession, path).where(F.col("batch") < number)
        record(receipts(answer(unanswered(rows, columns, known, most)), columns), path, number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str, out: str) -> None:
    """The log of ``path`` with one sound result per finished request and every receipt of the others, as one batch at ``out``.

    It is written beside the old log, so a run that is lost leaves that as it was.
    """
    rows = log(spark, path)
    done = current(rows).where("state = 'done'").select("request_hash", F.col("result").alias("_kept"))
    both = rows.join(done, "request_hash", "left")
    kept = both.where("_kept is null").unionByName(both.where("_kept is not null and status = 'ok' and result = _kept").where(sound(both)).dropDuplicates(["request_hash"]))
    record(kept.drop("_kept", "batch"), out, 0)
