"""Line dedup: lines that many documents share stay in one of them; a document's decision is a compressed bitmap.

Lines travel as hashes, never as text. They are range-partitioned by hash and document and sorted by document and
position within, so a line that a third of all rows hold is spread over many tasks; each task streams the first
occurrence of every line in every document. Only these firsts are counted, in two steps. What comes back to a document is
the run-length form of its keep bitmap.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import sized, staged

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\f\r"
#: Keys to drop (24 bytes each), bitmaps (some 60 bytes each) and runs in them (8 bytes each) that a join may broadcast.
BROADCAST_KEYS, BROADCAST_BITMAPS, BROADCAST_RUNS = 1_000_000, 500_000, 4_000_000


@dataclass(frozen=True)
class Shared:
    """Keys of at least ``chars`` code points that at least ``docs`` documents hold are shared."""

    chars: int = 20
    docs: int = 3


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z as a-z."""
    return F.translate(F.trim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def body_mark(text: Column) -> Column:
    """Tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, shared: Shared) -> DataFrame:
    """doc_id, mark, n_lines, pos, h, g of every line that is long enough: h and g hash its key, pos counts from 0."""
    lines = docs.select("doc_id", body_mark(F.col("text")).alias("mark"), lines_of(F.col("text")).alias("lines"))
    each = lines.select("doc_id", "mark", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = each.where(F.char_length(F.trim("line", F.lit(BLANK))) >= shared.chars).select("doc_id", "mark", "n_lines", "pos", line_key(F.col("line")).alias("key"))
    return keyed.select("doc_id", "mark", "n_lines", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def keep_bitmaps(docs: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Return doc_id, mark, n_lines int, keep array<struct<first int, n int>>: the runs of lines that stay, for every
    document that loses some.

    A shared key keeps its lines in the largest doc_id that holds it and loses them elsewhere. Rows of one doc_id are one
    document, rows with a null doc_id are one too, smaller than all others; repeated rows count once. A bitmap without
    runs keeps nothing. An empty table gives an empty result.
    """
    shared = shared or Shared()
    # the exchange by range serves the window as well: its rows only have to be sorted
    ranged = line_rows(docs, shared).repartitionByRange("h", "g", "doc_id")
    first = F.row_number().over(Window.partitionBy("h", "g", "doc_id").orderBy("pos")) == 1
    rows = staged(ranged.select("*", first.alias("first")), "lines")
    counts = rows.where("first").groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    keys = sized(counts.where(F.col("docs") >= shared.docs).select("h", "g", "keeper"), BROADCAST_KEYS, "shared-lines")
    gone = rows.join(keys, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    each = gone.groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("p"))
    start = lambda k: F.when(k == 0, 0).otherwise(F.get("p", k - 1) + 1)  # noqa: E731  runs of kept lines lie between dropped ones
    end = lambda k: F.coalesce(F.get("p", k), F.col("n_lines"))
    runs = F.transform(F.sequence(F.lit(0), F.size("p")), lambda k: F.struct(start(k).alias("first"), (end(k) - start(k)).alias("n")))
    return each.select("doc_id", "mark", "n_lines", F.filter(runs, lambda r: r["n"] > 0).alias("keep"))


def dedup_lines(docs: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Return doc_id, n_lines long, n_dropped long, kept string: one row per row of ``docs`` (doc_id, text).

    Lines are cut at line feeds; those that ``keep_bitmaps`` drops are missing from kept, the others are joined again. A
    null text is empty and has one empty line. Other columns are neither read nor returned.
    """
    bits = staged(keep_bitmaps(docs, shared).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "keep"), "bitmaps")
    extent = bits.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("keep")), F.lit(0)).alias("runs")).first()
    bits = F.broadcast(bits) if extent.rows <= BROADCAST_BITMAPS and extent.runs <= BROADCAST_RUNS else bits
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), body_mark(F.col("text")).alias("mark"))
    rows = rows.join(bits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    n = F.size(lines_of(F.col("text")))
    # the lines are a variable, so that a text is cut once and not for each of its runs
    runs = F.transform(F.array(lines_of(F.col("text"))), lambda lines: F.flatten(F.transform("keep", lambda r: F.slice(lines, r["first"] + 1, r["n"]))))
    kept = F.array_join(F.get(runs, F.lit(0)), "\n")
    stay = F.aggregate("keep", F.lit(0), lambda a, r: a + r["n"])
    return rows.select(
        "doc_id", n.cast("long").alias("n_lines"), F.when(F.col("keep").isNull(), F.lit(0)).otherwise(n - stay).cast("long").alias("n_dropped"), F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept")
    )


def line_digests(docs: DataFrame, shared: Shared | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept of every document."""
    return dedup_lines(docs, shared).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
