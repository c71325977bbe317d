"""Helpers shared by the operators: table access, the shared scratch folder, staged tables."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; Spark's own readers only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local a temporary folder of this machine is taken and set as
    the session's checkpoint folder; on a cluster its absence is an error, as executors share no other folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="lexigauge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lexigauge/{name}-{uuid.uuid4().hex}"


#: Rows that travel to a Python worker at once: texts are a few KB on average, so a batch stays at a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators, where it does not set a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Folders that the innermost ``temporary`` block will remove, if one is open.
_OPEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what ``staged`` writes inside, but for tables that are to be kept.

    Results that are still to be read afterwards must have been staged with ``keep``.
    """
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts lineage and computes ``df`` once; the files outlive any executor, so a lost one costs a re-read only. Inside a
    ``temporary`` block they go with it, unless they are to be kept.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    paths = _OPEN.get()
    if paths is not None and not keep:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def light(of: Callable, *caches: Callable[[], None]) -> Callable:
    """``of`` (a function over the batches of a partition) that gives its memory back when the partition ends.

    A Python worker outlives its tasks; what its allocators and the given caches keep would add up over all workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            for clear in caches:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of a column: long texts then cost no more memory."""
    rows = max(1, int(batch.num_rows * most / max(most, batch.column(column).nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


#: Ids (8 bytes each) that a join may broadcast.
BROADCAST_IDS = 1_000_000


def sized(table: DataFrame, most: int, name: str) -> DataFrame:
    """``table`` written and counted, for a join: marked for broadcast up to ``most`` rows, joined by shuffle beyond."""
    table = staged(table, name)
    return F.broadcast(table) if table.count() <= most else table


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is not in ``ids``; rows with a null key stay.

    Up to BROADCAST_IDS ids are broadcast, so the documents are not shuffled; more are joined by shuffle.
    """
    gone = ids.select(key).where(f"{key} is not null").distinct()
    columns = docs.columns
    return docs.join(sized(gone, BROADCAST_IDS, "without"), key, "left_anti").select(*columns)


def within(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is in ``ids``, joined like ``without``."""
    columns = docs.columns
    return docs.join(sized(ids.select(key).distinct(), BROADCAST_IDS, "within"), key, "left_semi").select(*columns)
