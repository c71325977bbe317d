"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

The trie is a table of edges, one per node and letter, with a node named by the hash of its prefix; words of each length
have a trie of their own, read from the left and from the right. A pair one edit apart agrees in the first half or in the
last half of the longer word, so a walk from the left starts behind the first half without edits, and one from the right
covers edits in that half. At each level the frontier of states (word, position, node, edits) is joined with the edges of
that depth: an unedited state takes a greater letter (a replacement, met once per pair), or has left out a letter and goes
on in the trie of the shorter words; an edited state takes its word's next letter. A state that reaches a leaf is a pair.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, small_batches, staged

#: A run of letters: Latin, with the accented range.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Words of more code points than this are not walked (a level for each letter) but matched by what is left without a letter.
WALKED = 64


def misprinted(word: Column, doc_id: Column, one_in: int) -> Column:
    """``word``, without one letter where the CRC of ``doc_id:word`` is a multiple of ``one_in``; a null id is empty."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(crc, F.char_length(word).cast("long")).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(F.pmod(crc, F.lit(one_in)) == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, letters: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """word, n: words of at least ``letters`` code points that occur ``least`` times or more; counted before they are shuffled.

    A word has at most as many letters as its run, so shorter runs are never made into rows.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{letters},}}"), F.lit(0))).alias("run"))
    words = runs.select(misprinted(F.translate("run", string.ascii_uppercase, string.ascii_lowercase), F.col("doc_id"), one_in).alias("word"))
    return words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _node(back: Column, size: Column, prefix: Column) -> Column:
    return F.xxhash64(back, size, prefix)


def _letter(word: str, at: Column) -> Column:
    """The letter of a word at a position from 0; empty behind its end."""
    return F.substring(F.col(word), at + 1, F.lit(1))


def _bit(of: Column) -> Column:
    """One of 64 bits by hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(of), F.lit(64)).cast("int"))


def _walks(words: DataFrame) -> DataFrame:
    """Every word from the left and from the right: word, n, back, w (as it is read), size, start (of its walk)."""
    size = F.char_length("word")
    both = words.select("word", "n", size.alias("size"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.floor(F.col("size") / 2).cast("int")
    return both.select("n", "back", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("w"), "size", F.when(F.col("back"), F.col("size") - half).otherwise(half).alias("start"))


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node, letter, child, next, after: the edges that walks can reach.

    ``next`` and ``after`` say, in 64 bits each, by which letter and by which two letters the child may go on; a state
    that they rule out would not survive the next two levels. Leaves allow everything.
    """
    at, size = F.col("depth"), F.col("size")
    places = _walks(words).select("back", "w", "size", F.explode(F.sequence(F.greatest(F.col("start") - 1, F.lit(0)), F.col("size") - 1)).alias("depth"))
    rest = size - at - 1
    one = F.when(rest >= 1, _bit(_letter("w", at + 1))).otherwise(F.lit(-1).cast("long"))
    two = F.when(rest >= 2, _bit(F.substring(F.col("w"), at + 2, F.lit(2)))).otherwise(F.lit(-1).cast("long"))
    rows = places.select(
        "depth", _node(F.col("back"), size, F.substring(F.col("w"), F.lit(1), at)).alias("node"), _letter("w", at).alias("letter"), _node(F.col("back"), size, F.substring(F.col("w"), F.lit(1), at + 1)).alias("child"),
        one.alias("next"), two.alias("after"),
    )
    return rows.groupBy("depth", "node", "letter", "child").agg(F.bit_or("next").alias("next"), F.bit_or("after").alias("after"))


def _births(walks: DataFrame, depth: int) -> DataFrame:
    """The states that leave a word's own path at this depth: w, n, back, size, pos, node, at, changed.

    Unedited states stand at the word's own node (changed is null: the edge's letter will replace the word's). A letter is
    left out behind the one that is read here, so the node is the same prefix in the trie of the shorter words; of a run
    of equal letters the first in the word goes.
    """
    own = F.substring(F.col("w"), F.lit(1), F.lit(depth))
    replace = walks.where((F.col("start") <= depth) & (F.col("size") > depth))
    replace = replace.select("w", "n", "back", "size", F.lit(depth).alias("pos"), _node(F.col("back"), F.col("size"), own).alias("node"), F.lit(depth).alias("at"), F.lit(None).cast("string").alias("changed"))
    gone, last = _letter("w", F.lit(depth + 1)), F.col("size") == depth + 2
    first = F.when(F.col("back"), last | (gone != _letter("w", F.lit(depth + 2)))).otherwise(gone != _letter("w", F.lit(depth)))
    leave = walks.where((F.col("start") <= depth + 1) & (F.col("size") > depth + 1) & first)
    leave = leave.select("w", "n", "back", "size", F.lit(depth).alias("pos"), _node(F.col("back"), F.col("size") - 1, own).alias("node"), F.lit(depth + 1).alias("at"), F.lit("").alias("changed"))
    return replace.unionByName(leave)


def walked_pairs(words: DataFrame) -> DataFrame:
    """word, n, near: pairs of words (of at most WALKED code points) one edit apart, each once, by the trie."""
    short = words.where(F.char_length("word") <= WALKED)
    extent = short.agg(F.min(F.char_length("word")).alias("least"), F.max(F.char_length("word")).alias("most")).first()
    edges = staged(trie_edges(short).sortWithinPartitions("depth"), "edges")  # so that a level reads its own pages only
    walks = _walks(short)
    frontier, ended = None, []
    for depth in range(max((extent.least or 0) // 2 - 1, 0), extent.most or 0):
        states = _births(walks, depth)
        if frontier is not None:
            states = states.unionByName(frontier)
        # an edited state reads the letter at pos; one that is about to leave out `at` reads the letter before it
        states = states.withColumn("letter", _letter("w", F.col("pos")))
        fresh = F.col("changed").isNull()
        skip = (F.col("changed") == "") & (F.col("at") == F.col("pos") + 1)
        then = F.col("pos") + F.when(skip, 2).otherwise(1)
        edge = edges.where(F.col("depth") == depth).select(F.col("node").alias("from"), F.col("letter").alias("taken"), "child", "next", "after")
        fits = (F.col("node") == F.col("from")) & F.when(fresh, F.col("taken") > F.col("letter")).otherwise(F.col("taken") == F.col("letter"))
        ahead = F.col("size") - then
        on = ((ahead < 1) | (F.col("next").bitwiseAND(_bit(_letter("w", then))) != 0)) & ((ahead < 2) | (F.col("after").bitwiseAND(_bit(F.substring(F.col("w"), then + 1, F.lit(2)))) != 0))
        moved = states.join(edge, fits).where(on).select("w", "n", "back", "size", then.alias("pos"), F.col("child").alias("node"), "at", F.when(fresh, F.col("taken")).otherwise(F.col("changed")).alias("changed"))
        moved = staged(moved, "frontier")
        ended.append(moved.where("pos = size"))
        frontier = moved.where("pos < size")
    if not ended:
        return words.select("word", "n", F.col("word").alias("near")).where("false")
    leaves = ended[0]
    for more in ended[1:]:
        leaves = leaves.unionByName(more)
    other = F.concat(F.substring(F.col("w"), F.lit(1), F.col("at")), F.col("changed"), F.substring(F.col("w"), F.col("at") + 2, F.col("size")))
    turned = lambda x: F.when(F.col("back"), F.reverse(x)).otherwise(x)
    return leaves.select(turned(F.col("w")).alias("word"), "n", turned(other).alias("near"))


#: Two prime moduli and bases of the sums by which long words are matched; a match is compared letter by letter after.
PRIMES, BASES = (2147483629, 2147483587), (1000003, 92821)


def left_out(word: str) -> np.ndarray:
    """A number for the word without each of its letters, and last for the whole word: sums of code points times powers."""
    points = np.array([ord(c) for c in word], np.uint64)
    found = np.zeros(len(points) + 1, np.uint64)
    for prime, base in zip(PRIMES, BASES, strict=True):
        powers = np.ones(1, np.uint64)
        while len(powers) < len(points):
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[: len(points)] % np.uint64(prime))]) % np.uint64(prime)
        behind = (sums[-1] + np.uint64(prime) - sums[1:]) % np.uint64(prime) * np.uint64(pow(base, -1, prime)) % np.uint64(prime)
        found = found << np.uint64(31) | np.append((sums[:-1] + behind) % np.uint64(prime), sums[-1])
    return found


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = left_out(word.as_py()).view(np.int64)
            for i in range(0, len(h), 10_000):
                part = h[i : i + 10_000]
                size = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([number] * size, pa.int64()), pa.array(np.arange(i, i + size, dtype=np.int32)), pa.array([len(h) - 1] * size, pa.int32()), pa.array(part)], names=["id", "at", "size", "h"])


def long_pairs(words: DataFrame) -> DataFrame:
    """word, n, near: pairs one edit apart of which the longer word has over WALKED code points.

    A word gives one number for each letter left out. Words of one length that agree without the letter at one position
    differ there only, so a bucket holds a word for each letter of the alphabet at most; the shorter of a pair agrees with
    the longer without a letter. Work is linear in the letters.
    """
    small_batches(words.sparkSession)
    many = words.where(F.char_length("word") >= WALKED).select("word", "n", F.xxhash64("word").alias("id"))
    if many.isEmpty():
        return words.select("word", "n", F.col("word").alias("near")).where("false")
    numbers = many.select("id", "word").mapInArrow(light(_numbers), "id long, at int, size int, h long")
    numbers = staged(numbers, "left-out")
    own = numbers.where("at = size").select(F.col("id").alias("a"), F.col("size").alias("own"), F.col("h"))
    part = numbers.where("at < size")
    swapped = part.select(F.col("id").alias("a"), "size", "at", "h").join(part.select(F.col("id").alias("b"), "size", "at", "h"), ["size", "at", "h"]).where("a < b").select("a", "b")
    shorter = part.select(F.col("id").alias("b"), (F.col("size") - 1).alias("own"), "h").join(own, ["own", "h"]).select("a", "b").distinct()
    pairs = swapped.unionByName(shorter).distinct()
    named = pairs.join(many.select(F.col("id").alias("a"), "word", "n"), "a").join(many.select(F.col("id").alias("b"), F.col("word").alias("near")), "b")
    longer = F.greatest(F.char_length("word"), F.char_length("near")) > WALKED
    return named.where(longer & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, in both directions. ``words``: word, n."""
    pairs = walked_pairs(words).unionByName(long_pairs(words))
    pairs = staged(pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"), "near")
    return pairs.select("word", "n", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_variants(docs: DataFrame, letters: int = 7, least: int = 2, one_in: int = 31, times: int = 10) -> DataFrame:
    """Return word, n long, n_near long, form string, form_n long, root string: one row per word of ``docs`` (doc_id, text).

    form is the near word of largest n (ties: the smallest) if it occurs ``times`` times as often or more; root is what
    forms lead to. Every row is counted, repeated ones too; null, empty and wordless texts have no words, an empty table
    gives an empty result. Other columns are neither read nor returned.
    """
    words = staged(word_counts(docs, letters, least, one_in), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    forms = staged(joined.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    # n grows `times`-fold from a word to its form, so paths are short; each round doubles what is covered
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = 1
    while times**steps <= most:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = staged(roots.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
        steps *= 2
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
