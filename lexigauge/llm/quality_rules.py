"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram over the common words of its language are compared to those of
the language (all its documents together) by Jensen-Shannon distance. Short texts are guarded: below a minimum length a
histogram says nothing, and the bound on the word distance widens with the sampling noise of a short text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import light, small_batches, staged
from lexigauge.llm.textstats import CLASSES, TextStats, class_counts


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict."""

    min_words: int = 50  # base rule: shorter texts fail
    max_repeat_percent: int = 50  # base rule: share of words in repeated 3-word windows
    common_words: int = 40  # words of a language's histogram; all others are one more bin
    min_chars: int = 200  # guard: below, the character histogram is not judged
    min_histogram_words: int = 50  # guard: below, the word histogram is not judged
    max_char_distance: float = 0.30
    max_word_distance: float = 0.22  # plus word_noise / sqrt(words)
    word_noise: float = 1.5
    min_reference_words: int = 5000  # guard: languages with less text have no reference, their distances are not judged


@dataclass
class Reference:
    """Histograms of one language."""

    chars: np.ndarray
    bins: dict[str, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.ones(1))


def references(docs: DataFrame, rules: Rules, text: str = "text", lang: str = "lang") -> DataFrame:
    """Histograms of every language of ``min_reference_words`` or more words, over all its documents (null: the language ""):
    lang, classes array<long>, common array<struct<rank, word, share>>.

    Two partial aggregations; nothing is collected, so any number of languages has a reference.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), body.alias("text"))
    names = [f"c{i}" for i in range(len(CLASSES))]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per language and task."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[name] = sums.get(name, 0) + class_counts(body.as_py())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), **{n: pa.array([int(v[i]) for v in sums.values()], pa.int64()) for i, n in enumerate(names)}})

    chars = rows.mapInArrow(light(classes), f"lang string, {', '.join(f'{n} long' for n in names)}").groupBy("lang").agg(F.array(*[F.sum(n) for n in names]).alias("classes"))
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = staged(words, "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= rules.min_reference_words)
    top = words.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= rules.common_words).join(totals, "lang")
    common = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", (F.col("n") / F.col("total")).alias("share")))).alias("common"))
    return common.join(chars, "lang").select("lang", "classes", "common")


def reference(classes: list[int], common: list[dict]) -> Reference:
    """A row of ``references`` as histograms."""
    h, p = np.array(classes, float), np.array([x["share"] for x in common])
    return Reference(h / max(h.sum(), 1), {x["word"]: i for i, x in enumerate(common)}, np.append(p, max(0.0, 1 - p.sum())))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2: 0 to 1) of two distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, terms / 2)))


def judge(s: TextStats, ref: Reference | None, rules: Rules) -> dict:
    """The counts and the verdict of one text. Without a reference of its language only the base rule is judged."""
    char = word = None
    if ref and s.n_chars >= rules.min_chars:
        char = round(distance(s.classes / s.n_chars, ref.chars), 6)
    if ref and s.n_words >= rules.min_histogram_words:
        rest = len(ref.bins)
        bins = np.array([ref.bins.get(w.decode().lower(), rest) for w in s.distinct])
        word = round(distance(np.bincount(bins[s.ids], minlength=rest + 1) / s.n_words, ref.words), 6)
    failed = s.n_words < rules.min_words or 100 * s.n_repeat_words > rules.max_repeat_percent * s.n_words
    far = (char is not None and char > rules.max_char_distance) or (word is not None and word > rules.max_word_distance + rules.word_noise / np.sqrt(s.n_words))
    return {"n_words": s.n_words, "word_chars": s.word_chars, "n_symbols": s.n_symbols, "n_dup_lines": s.n_dup_lines, "n_repeat_words": s.n_repeat_words, "base_failed": bool(failed), "char_distance": char, "word_distance": word, "kept": not failed and not far}


FIELDS = (("n_words", pa.int64(), "bigint"), ("word_chars", pa.int64(), "bigint"), ("n_symbols", pa.int64(), "bigint"), ("n_dup_lines", pa.int64(), "bigint"), ("n_repeat_words", pa.int64(), "bigint"), ("base_failed", pa.bool_(), "boolean"), ("char_distance", pa.float64(), "double"), ("word_distance", pa.float64(), "double"), ("kept", pa.bool_(), "boolean"))


#: References (about 2 KB each) that may be broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 5000


def assessed(docs: DataFrame, keep: Sequence[str], rules: Rules, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row of ``docs`` as columns row (struct of ``keep``) and q (struct of counts and verdict)."""
    small_batches(docs.sparkSession)
    known = staged(references(docs, rules, text, lang), "references")
    small = known.count() <= BROADCAST_LANGUAGES
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    packed = packed.join(F.broadcast(known) if small else known, "lang", "left").select("row", "text", "lang", "classes", "common")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs: dict[str, Reference | None] = {}  # of this batch: a language's rows carry the same reference
            found = []
            for k, (t, name) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                if name not in refs:
                    refs[name] = reference(batch.column(3)[k].as_py(), batch.column(4)[k].as_py()) if batch.column(4)[k].is_valid else None
                found.append(judge(TextStats(t.as_py()), refs[name], rules))
            q = pa.StructArray.from_arrays([pa.array([x[n] for x in found], t) for n, t, _ in FIELDS], names=[n for n, _, _ in FIELDS])
            yield pa.RecordBatch.from_arrays([batch.column(0), q], names=["row", "q"])

    return packed.mapInArrow(light(of), f"row {packed.schema['row'].dataType.simpleString()}, q struct<{','.join(f'{n}:{k}' for n, _, k in FIELDS)}>")


def quality_rules(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Return doc_id, the counts, base_failed, char_distance, word_distance and kept: one row per input row.

    Reads doc_id, text and lang. Null and empty texts have no words, fail the base rule and have null distances; a null
    language counts as the language ""; texts of languages with too little text for a reference have null distances and are
    judged by the base rule only. Repeated rows are judged alike. Null ids pass through. Other columns are neither read
    nor returned. An empty table gives an empty result.
    """
    return assessed(docs, ["doc_id"], rules or Rules()).select("row.doc_id", "q.*")


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, null ids and repeats included."""
    return assessed(docs, docs.columns, rules or Rules()).where("q.kept").select("row.*")
