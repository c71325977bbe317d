"""Near-duplicates by similarity: SimHash first, then an exact join of shingle sets by the prefixes of one common order.

Texts whose fingerprints are equal or differ in RADIUS bits at most are candidates, and whole sets verify them: these links
give the components from which everything else starts. At 0.8 of the shingles fingerprints differ in about ten bits, more
than balls can reach, so what SimHash leaves apart goes through a join that misses nothing.

All sets are sorted in one order, rarest shingles first. Two sets of n and m shingles whose Jaccard similarity is t or more
share at least t * n of the one and t * m of the other, so they share a shingle among the first n - ceil(t * n) + 1 of the one
and the first m - ceil(t * m) + 1 of the other. Texts that share such a shingle are candidates unless they are in one
component already; whole sets verify them. The order decides how many candidates there are, never which texts are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import light, sized, slices, small_batches, staged, temporary, within, without
from lexigauge.llm.graph import components
from lexigauge.llm.simhash import fingerprint, links, shingle_hashes

#: Words of a shingle; bits in which fingerprints of candidates may differ.
WORDS, RADIUS = 5, 2
#: The order of shingles: one in SAMPLE texts is counted, by 2 ** BITS counters of hashes; counts of LEAST and more are kept.
SAMPLE, BITS, LEAST = 16, 22, 3
#: Marks of copied texts (about 40 bytes each) that may be broadcast.
BROADCAST_MARKS = 500_000


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles begin with each byte, as unsigned 32-bit integers."""
    return np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256).astype("<u4").tobytes()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets), pa.array([sketch(x) for x in sets], pa.binary())], names=["doc_id", "shingles", "sketch"])


def counters(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The counter of each shingle: its lowest bits, which ``sketch`` does not look at."""
    return (shingles & np.uint64((1 << bits) - 1)).astype(np.int64)


def shingle_counts(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """How often shingles are in a sample of the distinct texts (columns doc_id, mark, text), by counter, as 16 bits each.

    The counters have one size whatever the corpus holds: no shingle is left out, and one that shares its counter with a
    commoner one only counts as common too. Counts are added up by Spark; what reaches the driver is a row per counter.
    """
    some = rows.where(F.pmod(F.xxhash64("mark"), F.lit(SAMPLE)) == 0).dropDuplicates(["mark"]).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = some.mapInArrow(light(_sets), f"doc_id {kind}, shingles array<bigint>, sketch binary")
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= LEAST).select("c", F.least("n", F.lit(65_535)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.uint16)
    out[found.column("c").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix(shingles: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles in the common order, rare ones first; one zero for an empty set."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)
    weight = counts[counters(shingles, len(counts).bit_length() - 1)]
    least = int(np.ceil(similarity * n - 1e-9))
    return shingles[np.lexsort((shingles, weight))[: n - max(least, 1) + 1]]


def _sets_of(docs: DataFrame, pairs: DataFrame, text: Column) -> DataFrame:
    """doc_id, shingles and sketch of every document in ``pairs``; an id that repeats has a row for each of its texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    return staged(within(docs.select("doc_id", text.alias("text")), wanted).mapInArrow(light(_sets), f"doc_id {kind}, shingles array<bigint>, sketch binary"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole sets overlap by ``similarity`` or more.

    Two sets share at most the sum of the smaller counts of their sketches; pairs that this bound rules out do not carry
    their sets any further.
    """

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, 256).astype(np.int64) for k in (2, 3))
            keep = np.minimum(x, y).sum(1) * (1 + similarity) >= (x.sum(1) + y.sum(1)) * similarity - 1e-6
            yield batch.select([0, 1]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    near = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sketch").alias("p")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sketch").alias("q")), "b")
    near = staged(near.select("a", "b", "p", "q").mapInArrow(light(hopeful), f"a {kind}, b {kind}").distinct(), "hopeful")
    whole = within(sets.select("doc_id", "shingles"), near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))))
    both = near.join(whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    alike = F.coalesce(F.try_divide(shared, F.size("x") + F.size("y") - shared), F.lit(1.0)) >= similarity
    return both.where(alike).select("a", "b").distinct()


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Candidate pairs (a, b) of ``nodes`` (node, fingerprint): the smallest node of a fingerprint and each other one of it,
    and the smallest nodes of fingerprints that meet in a ball, so that pairs connect what lies within ``radius`` bits."""
    least = staged(nodes.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    same = nodes.join(least.where("n > 1"), "fingerprint").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    met = links(least.select("fingerprint"), radius)
    for side in ("a", "b"):
        met = met.join(least.select(F.col("fingerprint").alias(side), F.col("least").alias(f"node_{side}")), side)
    near = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return same.unionByName(near).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``roots`` (node, root) does not put into one component."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether sets may reach the similarity if what they share at ``at`` is the first they share: no pair is lost, as each
    is also met at its first."""
    size, at = (lambda s: F.col(f"{s}.size")), (lambda s: F.col(f"{s}.at"))
    rest = F.least(size(x) - at(x), size(y) - at(y))
    return (rest * (1 + similarity) >= (size(x) + size(y)) * similarity - 1e-6) | (F.greatest(size(x), size(y)) == 0)


def _rest(met: DataFrame, linked: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """All candidate pairs that ``linked`` (node, root) does not connect and that are not in ``tried``.

    ``met``: key, node, size, at of every text in a bucket of several. Buckets inside one component have no such pair. In
    the others the members of the bucket's largest component meet only those outside it, so a large group of near copies
    costs as much as its bucket has strangers, not its square.
    """
    rooted = met.join(linked, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "largest")
    mixed = staged(rooted.join(largest, "key"), "mixed")
    x, y = mixed.where("root <> largest").alias("x"), mixed.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & ((F.col("x.root") < F.col("y.root")) | (F.col("y.root") == F.col("y.largest")))
    pairs = x.join(y, apart & _possible("x", "y", similarity)).select(F.greatest("x.node", "y.node").alias("b"), F.least("x.node", "y.node").alias("a"))
    return pairs.distinct().join(tried, ["a", "b"], "left_anti")


def similar_components(docs: DataFrame, similarity: float = 0.8, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, first, n) of documents and (node, root) of components that hold several texts.

    The first table has every document id, the smallest id among equal texts, and how many rows have the id. The second
    links these smallest ids where the sets of five-word shingles overlap by ``similarity`` or more, directly or through
    others.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.unhex(F.sha2(body, 256)).alias("mark"), body.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                sets = [shingle_set(t.as_py()) for t in batch.column(2)]
                keys = _lists([prefix(s, similarity, known.value) for s in sets])
                bits = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], bits, pa.array([len(s) for s in sets], pa.int32()), keys], names=["doc_id", "mark", "fingerprint", "size", "prefix"])

    marks = staged(rows.mapInArrow(light(prefixes), f"doc_id {kind}, mark binary, fingerprint bigint, size int, prefix array<bigint>"), "prefixes")
    # an id that repeats with another text is one document: its smallest node
    several = marks.groupBy("mark").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "node")
    placed = marks.join(sized(several, BROADCAST_MARKS, "copied"), "mark", "left")
    firsts = staged(placed.groupBy("doc_id").agg(F.min(F.coalesce("node", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")

    nodes = placed.where("node is null or node = doc_id").select(F.col("doc_id").alias("node"), "fingerprint", "size", "prefix")
    # first what the fingerprints say
    alike = staged(simhash_pairs(nodes.select("node", "fingerprint")), "alike")
    linked = staged(_verified(alike, _sets_of(docs, alike, body), similarity), "simhash-links")
    known_roots = staged(components(linked), "simhash-roots")

    met = nodes.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    order = Window.partitionBy("key").orderBy("node")
    text_of = F.struct("node", "size", "at")
    met = met.select("key", "node", "size", "at", F.lag(text_of).over(order).alias("last"), F.first(text_of).over(order).alias("least"), F.lead("node").over(order).alias("next"))
    met = staged(met.where("last is not null or next is not null").drop("next"), "met")

    # then, in each bucket, every text that these leave apart against the one before and the first: most links of near copies, in linear work
    near = met.where("last is not null").select(F.struct("node", "size", "at").alias("y"), "last", "least")
    pairs = [near.where(_possible(x, "y", similarity)).select(F.col(f"{x}.node").alias("a"), F.col("y.node").alias("b")).where("a <> b").distinct() for x in ("last", "least")]
    pairs = staged(_apart(pairs[0].unionByName(pairs[1]).distinct(), known_roots).join(alike, ["a", "b"], "left_anti"), "candidates")
    sets = _sets_of(docs, pairs, body)
    linked = staged(linked.unionByName(_verified(pairs, sets, similarity)), "links")
    # last, all pairs of a bucket that these links leave apart
    tried = alike.unionByName(pairs)
    rest = staged(_rest(met.select("key", "node", "size", "at"), components(linked), tried, similarity), "rest")
    return firsts, components(linked.unionByName(_verified(rest, _sets_of(docs, rest, body), similarity)))


def _texts_of_repeated_ids(docs: DataFrame, similarity: float, text: str) -> DataFrame:
    """``drop_near_duplicates`` where ids repeat: every text of an id is a document of its own, named by a hash of both."""
    named = docs.where("doc_id is not null").withColumn("_number", F.xxhash64("doc_id", F.coalesce(text, F.lit(""))))
    others = [c for c in docs.columns if c not in ("doc_id", text)]
    one = named.groupBy("_number", "doc_id", F.coalesce(text, F.lit("")).alias("_body")).agg(F.min(F.struct(F.col(text).isNull().alias("_null"), *others)).alias("_row"))
    one = staged(one, "texts")
    with temporary(docs.sparkSession):
        firsts, linked = similar_components(one.select(F.col("_number").alias("doc_id"), F.col("_body").alias("text")), similarity)
        of = firsts.select(F.col("doc_id").alias("_number"), F.col("first").alias("node")).join(linked, "node", "left").select("_number", F.coalesce("root", "node").alias("root"))
        best = one.select("_number", "doc_id").join(of, "_number").groupBy("root").agg(F.min(F.struct("doc_id", "_number")).alias("b"))
        best = staged(best.select(F.col("b._number").alias("_number")), "best", keep=True)
    kept = within(one, best, "_number")
    whole = {"doc_id": F.col("doc_id"), text: F.when(~F.col("_row._null"), F.col("_body")).alias(text), **{c: F.col("_row")[c].alias(c) for c in others}}
    return kept.select(*[whole[c] for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, with all its columns: the one of smallest doc_id.

    Texts whose sets of five-word shingles (A-Z as a-z; a shorter text is one shingle) overlap by ``similarity`` or more,
    by Jaccard, are near-duplicates; groups are what links reach. Null and empty texts are equal; all texts without words
    are alike. Where an id repeats, each of its different texts is a document; of equal rows, and of rows that differ in
    further columns only, the smallest in the order of these columns stays. Rows with a null doc_id stay. An empty table
    gives an empty result.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _texts_of_repeated_ids(docs, similarity, text)
    with temporary(docs.sparkSession):
        firsts, linked = similar_components(docs, similarity, text)
        copies = firsts.where("first <> doc_id").select("doc_id")
        near = linked.where("node <> root").select(F.col("node").alias("doc_id"))
        gone = staged(copies.unionByName(near).distinct(), "gone", keep=True)
    return without(docs, gone)
