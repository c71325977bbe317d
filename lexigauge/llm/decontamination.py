"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask selects tokens of a window and ignores the others. Benchmark and training windows that share a hash are hits;
around each hit the item is laid over the document and matching tokens are counted, which tolerates substitutions. An item
is searched with the first family of masks that no overlay which the rule accepts can avoid, so none is missed; which
families these are for which item lengths is computed from the rule, see ``unmissable``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import staged, without

#: Families of masks (1 selects a token), the most selective first. The last finds whatever shares a token.
FAMILIES = (("11101", "100111", "11000011"), ("1101", "1011", "111"), ("11", "101", "1001"), ("1",))


@dataclass(frozen=True)
class Overlap:
    """Parameters: an item is found in a document if its best overlay matches ``share`` of its tokens, or a stretch of it
    scores ``stretch`` with +1 for a match and -``miss`` for a mismatch."""

    share: float = 0.7
    stretch: int = 12
    miss: int = 2


#: What may be broadcast: rows of the seed table (five numbers each) and tokens of the items; more is joined by shuffle.
BROADCAST_SEEDS, BROADCAST_TOKENS = 1_000_000, 4_000_000
#: Lengths whose family is worked out one by one; a period by which longer ones follow.
LENGTHS, PERIOD = 120, 60


def avoidance(masks: tuple[str, ...], lengths: int) -> list[int]:
    """How many mismatches keep every mask from fitting into n positions, at least, for n = 0 to ``lengths``.

    A walk over positions that remembers which of the last ones match.
    """
    states = 1 << (max(map(len, masks)) - 1)
    seen = np.arange(2 * states)
    hit = np.logical_or.reduce([(seen & int(m, 2)) == int(m, 2) for m in masks])
    cost, out = np.full(states, 10**6), [0]
    cost[0] = 0  # what lies before the first position matches nothing
    for _ in range(lengths):
        new = np.where(hit, 10**6, cost[seen >> 1] + 1 - (seen & 1))
        cost = np.minimum(new[:states], new[states:])  # the oldest position is forgotten
        out.append(int(cost.min()))
    return out


def unmissable(overlap: Overlap) -> list[int]:
    """The family of items of n tokens, for n = 0 to LENGTHS + 1; the last holds for all longer items too.

    No overlay that ``overlap`` accepts avoids it: neither with as many mismatches as ``share`` allows, nor in any
    stretch of stretch + (miss + 1) * k tokens with k mismatches. For longer items both allowances grow by less per
    PERIOD than what the family tolerates.
    """
    allowed = [n - ceil(n * overlap.share - 1e-9) for n in range(LENGTHS + 1)]
    sure = []
    for masks in FAMILIES:
        needed = avoidance(masks, LENGTHS)
        stretch = [all(needed[m] > k for k in range(n) if (m := overlap.stretch + (overlap.miss + 1) * k) <= n) for n in range(LENGTHS + 1)]
        fits = [needed[n] > allowed[n] and stretch[n] for n in range(LENGTHS + 1)]
        grows = needed[PERIOD] > max(PERIOD * (1 - overlap.share) + 1, ceil(PERIOD / (overlap.miss + 1)))
        sure.append([*fits, all(fits[LENGTHS - PERIOD :]) and grows])
    last = len(FAMILIES) - 1
    return [next((i for i in range(last) if sure[i][n]), last) for n in range(LENGTHS + 2)]


def tokens(text: Column) -> Column:
    """Hashes of the tokens: runs of letters and digits, lower-cased. Null texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def seed(t: Column, number: int, mask: str, at: Column) -> Column:
    """Hash of what the mask selects of the token hashes ``t`` from ``at`` on. A window that leaves the text hashes fewer
    tokens, which no seed of an item does."""
    return F.xxhash64(F.lit(number), *[F.get(t, at + k) for k, c in enumerate(mask) if c == "1"])


def overlay(doc: Column, item: Column, shift: Column, miss: int) -> Column:
    """Lay ``item`` over ``doc`` at ``shift``: struct(matched tokens, best stretch, sum so far)."""
    start = F.struct(F.lit(0).alias("matched"), F.lit(0).alias("best"), F.lit(0).alias("now"))

    def step(a: Column, i: Column) -> Column:
        # positions before the document's first token or after its last are null, hence no match
        same = F.coalesce(F.when(shift + i >= 0, F.get(doc, shift + i)) == F.get(item, i), F.lit(False))
        now = F.greatest(a["now"] + F.when(same, F.lit(1)).otherwise(F.lit(-miss)), F.lit(0))
        return F.struct((a["matched"] + same.cast("int")).alias("matched"), F.greatest(a["best"], now).alias("best"), now.alias("now"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step)


def _seeds(items: DataFrame, masks: list[tuple[int, int, str]]) -> DataFrame:
    """Every window of every item under the masks (number, family, mask) of its family: seed, mask, number, at, before.

    ``before`` is the seed of the window one token earlier, if there is one.
    """
    size, at = F.size("item"), F.col("at")
    each = [
        F.when((F.col("family") == family) & (at + len(m) <= size), F.struct(F.lit(k).alias("mask"), seed(F.col("item"), k, m, at).alias("seed"), F.when(at > 0, seed(F.col("item"), k, m, at - 1)).alias("before")))
        for k, family, m in masks
    ]
    return items.select("number", "item", "family", F.posexplode("item").alias("at", "token")).select("number", "at", F.explode(F.array_compact(F.array(*each))).alias("s")).select("s.seed", "s.mask", "s.before", "number", "at")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, overlap: Overlap | None = None) -> DataFrame:
    """Return doc_id, item_id, matched int, item_tokens int, stretch int: one row per document and item found in it.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. matched counts the item's tokens met by its best overlay,
    stretch is the best scoring run of one. Whatever overlay ``overlap`` accepts is found, in items and documents of any
    length; null and empty texts and texts without letters or digits have no tokens, contain nothing and are found
    nowhere. Repeated items and documents are found once per id; documents with a null id count as one document, items
    with a null id as one item. Other columns are neither read nor returned. Without benchmark items the result is empty.

    The documents are scanned once; no document text is shuffled, only the hits' ids and counts are. Of a run of hits
    (windows that follow each other in both texts) only the first is laid over.
    """
    overlap = overlap or Overlap()
    family = F.element_at(F.array(*[F.lit(f) for f in unmissable(overlap)]), F.least(F.size("item"), F.lit(LENGTHS + 1)) + 1)
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = staged(items.select(F.xxhash64("item_id", "item").alias("number"), "item_id", "item", family.alias("family")), "items")
    extent = items.agg(F.sum(F.size("item")).alias("tokens"), F.collect_set("family").alias("families")).first()  # a family or four
    numbered = [(f, m) for f, masks in enumerate(FAMILIES) for m in masks]
    masks = [(k, f, m) for k, (f, m) in enumerate(numbered) if f in extent.families] or [(0, 0, FAMILIES[0][0])]
    own = staged(_seeds(items, masks), "seeds")
    small = own.count() <= BROADCAST_SEEDS and (extent.tokens or 0) <= BROADCAST_TOKENS

    rows = docs.select("doc_id", tokens(F.col("text")).alias("doc"))
    places = rows.select("doc_id", "doc", F.posexplode("doc").alias("pos", "token"))
    pos = F.col("pos")
    windows = places.select("doc_id", "doc", "pos", F.explode(F.array(*[seed(F.col("doc"), k, m, pos) for k, _, m in masks])).alias("seed"))
    before = F.coalesce(*[F.when(F.col("mask") == k, seed(F.col("doc"), k, m, pos - 1)) for k, _, m in masks])
    begins = (pos == 0) | F.col("before").isNull() | (F.col("before") != before)
    shift = (pos - F.col("at")).alias("shift")
    if small:
        hits = windows.join(F.broadcast(own), "seed").where(begins).select("doc_id", "doc", "number", shift)
        hits = hits.join(F.broadcast(items), "number")
    else:
        # too much to broadcast: windows meet the seeds by shuffle without their documents, which then come back by id
        earlier = F.array(*[F.struct(seed(F.col("doc"), k, m, pos).alias("seed"), seed(F.col("doc"), k, m, pos - 1).alias("earlier")) for k, _, m in masks])
        met = places.select("doc_id", "pos", F.explode(earlier).alias("w")).select("doc_id", "pos", "w.seed", "w.earlier").join(own, "seed")
        met = staged(met.where((pos == 0) | F.col("before").isNull() | (F.col("before") != F.col("earlier"))).select("doc_id", "number", shift).distinct(), "met")
        met = met.withColumnRenamed("doc_id", "of")
        hits = rows.join(met, F.col("doc_id").eqNullSafe(F.col("of"))).join(items, "number")
    laid = hits.select("doc_id", "item_id", F.size("item").alias("item_tokens"), overlay(F.col("doc"), F.col("item"), F.col("shift"), overlap.miss).alias("o"))
    found = (F.col("o.matched") >= F.ceil(F.col("item_tokens") * overlap.share - 1e-9)) | (F.col("o.best") >= overlap.stretch)
    best = laid.where(found).groupBy("doc_id", "item_id").agg(F.max("o.matched").alias("matched"), F.max("item_tokens").alias("item_tokens"), F.max("o.best").alias("stretch"))
    return best


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: Overlap | None = None) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns. Rows with a null doc_id are kept."""
    return without(docs, benchmark_hits(docs, benchmark, overlap))
