"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the radius of each. Every distinct fingerprint
therefore emits its ball of that half radius; fingerprints that meet on a variant are candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import light, sized, small_batches, staged
from lexigauge.llm.graph import components


#: Rows from which a fingerprint is one of mass copies, and how many of these may be broadcast.
HOT, BROADCAST_HOT = 1000, 500_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; a shorter text is one shingle, none without words.

    Words lie between ASCII white space; A-Z count as a-z.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits: bit i is 1 if set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        raw = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id and fingerprint long (the 64 bits, signed): one row per input row. Null texts have fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(light(of), f"doc_id {kind}, fingerprint bigint")


def ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` of 64 bits, as signed 64-bit integers; the empty mask first."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links a > b between distinct fingerprints (column fingerprint), enough of them to connect whatever links.

    Two fingerprints within an even radius meet on a variant that lies within half the radius of both; within an odd one
    the variant lies within the smaller half of one of them. So each fingerprint on a variant is linked to the smallest of
    those within the smaller half, which is within the radius of all the others.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in ball((radius + 1) // 2)])
    met = distinct.select("fingerprint", F.explode(masks).alias("m")).select("fingerprint", (F.bit_count("m") <= radius // 2).alias("core"), F.col("fingerprint").bitwiseXOR(F.col("m")).alias("variant"))
    least = F.min(F.when(F.col("core"), F.col("fingerprint"))).over(Window.partitionBy("variant"))
    pairs = met.select("fingerprint", least.alias("b")).where("fingerprint <> b").select(F.greatest("fingerprint", "b").alias("a"), F.least("fingerprint", "b").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, fingerprint (16 lower-case hex digits), component_id: one row per input row, repeats included.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that can
    be reached, the row's own included. Equal fingerprints are one node, so thousands of copies cost one ball. Null and
    empty texts, and texts of white space, have fingerprint zero and are linked like any other. A null doc_id is no
    component's smallest id unless all ids of the component are null. Other columns are neither read nor returned. An
    empty table gives an empty result.
    """
    marks = staged(fingerprints(docs, words, doc_id, text), "fingerprints")
    nodes = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = components(links(nodes.select("fingerprint"), radius))
    of = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = staged(of.join(named, "root").select("fingerprint", "component_id", "n"), "components")
    # the few fingerprints of mass copies go to the rows, so that no task gets all rows of one; the others meet by shuffle
    hot = sized(table.where(F.col("n") >= HOT).select("fingerprint", F.struct("component_id").alias("hot")), BROADCAST_HOT, "hot")
    rows = marks.join(hot, "fingerprint", "left")
    cold = rows.where("hot is null").drop("hot").join(table.where(F.col("n") < HOT), "fingerprint")
    placed = rows.where("hot is not null").select("doc_id", "fingerprint", "hot.component_id").unionByName(cold.select("doc_id", "fingerprint", "component_id"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
