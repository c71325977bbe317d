"""Raw records as a stream: a folder of JSON files becomes a status table; runs of failures open a breaker per model.

The batch operators in ``operators.integrity`` give the same answers on finished tables; these keep them current while
records still arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "key string, model string, status string, at timestamp, attempt int, content string"


def record_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Records of the JSON files of ``folder`` (one object per line); malformed lines and records without key or time are dropped."""
    rows = spark.readStream.schema(RECORD + ", _corrupt_record string").option("mode", "PERMISSIVE").option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.where("_corrupt_record is null and key is not null and at is not null").drop("_corrupt_record")


def once(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (key, attempt) once, however often a file is delivered within ``delay``."""
    return records.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key", "attempt"])


def status_counts(records: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Records by status per event-time window; windows close once the watermark has passed them."""
    return records.withWatermark("at", delay).groupBy(F.window("at", width), "status").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "status", "n")


def breakers(records: DataFrame, run: int = 5) -> DataFrame:
    """A row per model and batch: its current run of consecutive failures and whether its breaker is open.

    A batch counts as one set of records in order of (at, key), however it is cut into frames: the run is what failed
    after the last record that did not, or goes on where all have failed.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (0,)
        last, failed = None, []
        for frame in frames:
            error = frame["status"] == "error"
            fine = frame.loc[~error, ["at", "key"]]
            if len(fine):
                top = max(fine.itertuples(index=False, name=None))
                last = top if last is None else max(last, top)
            failed = [x for x in (*failed, *frame.loc[error, ["at", "key"]].itertuples(index=False, name=None)) if last is None or x > last]
        now = len(failed) + (now if last is None else 0)
        state.update((now,))
        yield pd.DataFrame({"model": [key[0]], "failures": [now], "open": [now >= run]})

    return records.groupBy("model").applyInPandasWithState(fold, "model string, failures long, open boolean", "failures long", "update", GroupStateTimeout.NoTimeout)
