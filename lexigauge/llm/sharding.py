"""Minimax contiguous partition of ordered atomic groups into shards.

The smallest feasible shard capacity is found by binary search with a greedy check. The check runs on the driver over
group ends (prefix sums) that are known there: first the ends of about ``RESOLUTION`` equal stretches, then, only where a
cut can still fall, the ends inside those stretches, until the answer is exact. What the driver holds never exceeds a few
times ``RESOLUTION`` numbers, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import staged

RESOLUTION, SPANS = 20_000, 64


class Ends:
    """Some of the ends of the groups, and which gaps between them hold further ends."""

    def __init__(self, total: int):
        self.total = total
        self.at: list[int] = [0, total]
        self.open: set[int] = {0}  # starts of gaps that may hold more ends

    def put(self, ends: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> None:
        """``ends``: (start, largest end, number of ends) of every stretch inside ``spans`` that holds an end."""
        inside = {x for a, b in spans for x in self.at[bisect_right(self.at, a) - 1 : bisect_right(self.at, b - 1)]}
        self.open -= inside
        self.at = sorted({*self.at, *(e for _, e, _ in ends)})
        for start, e, n in ends:
            if n > 1:
                self.open.update(self.at[bisect_right(self.at, start) - 1 : bisect_right(self.at, e - 1)])

    def cut(self, limit: int, hopeful: bool) -> int:
        """The last end that is at most ``limit``: the last one known, or if hopeful the best that could be."""
        i = bisect_right(self.at, limit) - 1
        return limit if hopeful and self.at[i] in self.open and limit < self.total else self.at[i]

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts of at most ``shards`` shards."""
        out, at = [], 0
        for _ in range(shards):
            new = self.cut(min(at + capacity, self.total), hopeful)
            out.append(new)
            if new >= self.total or new == at:
                break
            at = new
        return out

    def smallest(self, shards: int, hopeful: bool) -> int:
        """The smallest capacity whose greedy cuts reach the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, total: int, shards: int, resolution: int = RESOLUTION) -> list[int]:
    """Cut positions (inclusive ends of the shards, the last is ``total``) of the smallest feasible capacity.

    ``groups``: column end, the distinct prefix sums of the group sizes.
    """
    known, spans, width = Ends(total), [(0, total)], 2 * total
    while True:  # finer each time: the stretches where a cut can fall shrink much faster than the width
        width = max(1, min(sum(b - a for a, b in spans) // resolution, width // 2))
        inside = " or ".join(f"(end > {a} and end <= {b})" for a, b in spans)
        rows = groups.where(inside).groupBy(F.expr(f"(end - 1) div {width}").alias("k")).agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("n"))
        known.put([(r.k * width, r.e, r.n) for r in rows.collect()], spans)
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        early, late = known.cuts(low, shards, False), known.cuts(high, shards, True)
        need = set()
        for i in range(max(len(early), len(late))):
            a, b = early[min(i, len(early) - 1)], late[min(i, len(late) - 1)]
            for start in known.at[bisect_right(known.at, a) - 1 : bisect_right(known.at, max(a, b))]:
                if start in known.open:
                    need.add(start)
        if not need:
            return known.cuts(high, shards, False)
        starts = sorted(need)
        ends = [known.at[bisect_right(known.at, x)] for x in starts]
        # at most SPANS ranges to filter by: all but the widest distances between neighbours are covered too
        apart = sorted(range(1, len(starts)), key=lambda i: starts[i] - ends[i - 1])[-SPANS + 1 :]
        edges = [0, *sorted(i for i in apart if starts[i] > ends[i - 1]), len(starts)]
        spans = [(starts[i], ends[j - 1]) for i, j in zip(edges, edges[1:], strict=False)]


def even_cuts(groups: DataFrame, total: int, shards: int, resolution: int = RESOLUTION) -> list[int]:
    """Cuts of the smallest feasible capacity that lie as near as they can to equal shares of ``total``.

    Greedy cuts from the left are the latest that the capacity allows, those from the right the earliest. Each cut is
    the candidate nearest to its equal share among these two and the group ends next to the share, as long as the shard
    fits and the rest can still be cut.
    """
    late = minimax_cuts(groups, total, shards, resolution)
    if len(late) == 1:
        return late
    capacity = max(b - a for a, b in zip([0, *late], late, strict=False))
    mirrored = groups.where(f"end < {total}").select((F.lit(total) - F.col("end")).alias("end")).unionByName(groups.limit(1).select(F.lit(total).cast("long").alias("end")))
    back = minimax_cuts(mirrored, total, shards, resolution)
    early = [*([0] * (shards - len(back))), *(total - c for c in reversed(back[:-1]))]
    shares = [total * i // shards for i in range(1, shards)]
    near = groups.agg(*[f(F.when(F.expr(f"end {op} {s}"), F.col("end"))) for s in shares for f, op in ((F.max, "<="), (F.min, ">="))]).first()
    out = [0]
    for i, share in enumerate(shares):
        room = [c for c in (near[2 * i], near[2 * i + 1], early[i], late[min(i, len(late) - 1)]) if c is not None and max(early[i], out[-1]) <= c <= out[-1] + capacity]
        out.append(min(room or [out[-1]], key=lambda c: abs(c - share)))
    return [c for i, c in enumerate(out) if c > (out[i - 1] if i else 0) and c < total] + [total]


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text", resolution: int = RESOLUTION) -> DataFrame:
    """Return doc_id, size long, text_crc32 long, law string, shard int, slot long, grown_shard int (null).

    Size: UTF-8 bytes of the text (null: none) plus ``overhead``. Rows with equal texts form a group, which stays whole;
    groups are ordered by the SHA-256 of their text, rows of a group by doc_id. Shards 0 to ``shards`` - 1 are
    contiguous runs of groups; the largest is as small as any contiguous cut of this order allows, and among such cuts they
    are near equal shares (law ``bytes``). Slots
    count the rows of a shard from 0 without gaps. With few or very large groups the last shards may be empty. Null and
    empty texts are equal. Repeated rows each get a slot. Null ids come first in their group. Other columns are neither
    read nor returned. An empty table gives an empty result.

    Row order comes from one range partitioning on (text hash, doc_id): a group of any size is split over tasks, and
    only one total per task goes through a broadcast (as many rows as shuffle partitions).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("h"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(partitions, "h", "doc_id").sortWithinPartitions("h", "doc_id").withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("part").orderBy("h", "doc_id")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", F.sum("size").over(running).alias("upto"), F.row_number().over(within).alias("n")).join(F.broadcast(offsets), "part")
    placed = staged(placed.select("doc_id", "size", "text_crc32", "h", (F.col("upto") + F.col("bytes_before")).alias("upto"), (F.col("n") + F.col("rows_before") - 1).alias("row")), "placed")
    groups = staged(placed.groupBy("h").agg(F.max("upto").alias("end"), F.max("row").alias("last")), "groups")
    top = groups.agg(F.max("end")).first()[0]
    cuts = even_cuts(groups.select("end"), top, shards, resolution) if top is not None else []
    firsts = {r.end: r["last"] + 1 for r in groups.where(F.col("end").isin(cuts)).select("end", "last").collect()} if cuts else {}
    # a row lies in the shard of its group: the number of cuts before the start of its place in the order
    shard = sum(((F.col("upto") > F.lit(c)).cast("int") for c in cuts[:-1]), F.lit(0))
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in [0, *(firsts[c] for c in cuts[:-1])]]), F.col("shard") + 1)
    return (
        placed.withColumn("shard", shard.cast("int"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
