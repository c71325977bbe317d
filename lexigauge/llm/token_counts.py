"""Token counts by a two-tier lookup on the map side.

A compact table of frequent pre-token lengths is broadcast; what it lacks is encoded once per Python worker and kept in
that worker's bounded cache. No pre-token is shuffled: the table is made on the driver from a bounded sample of texts, and
decides only how often the library is asked, never a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, small_batches

#: How sentencepiece writes a space inside a piece (fixed by the library).
SPACE = "▁"
#: Texts of the sample, pre-tokens that each of them reports, entries of the broadcast table and of a worker's cache.
SAMPLE_TEXTS, TEXT_TOP, TABLE_SIZE, CACHE_SIZE = 4000, 512, 32768, 100_000


def pre_tokens(text: str) -> list[str]:
    """Keys of ``text``: its words without the space before each; a word that follows a line end carries that line end.

    The model's pieces hold the space mark only in front and never a line end, so no merge crosses these borders and the
    lengths of the keys add up to the length of the text. Empty strings stand for further spaces of a run.
    """
    return text.replace(SPACE, " ").replace("\n", " \n").split(" ")


class Lengths:
    """Pre-token -> number of tokens: the broadcast table first, then the worker's cache, else the library.

    The cache has two generations: when the newer one is full it becomes the older, and what is still in use moves back.
    """

    def __init__(self, model: str, frequent: dict[str, int], bound: int = CACHE_SIZE):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses a border of pre-tokens; this model cannot be counted by pre-tokens")
        self.frequent, self.bound = frequent, bound
        self.known: dict[str, int] = dict(frequent)
        self.older: dict[str, int] = {}

    def learn(self, keys: set[str]) -> None:
        """See to it that all of ``keys`` are known."""
        if len(self.known) > self.bound + len(self.frequent):
            self.older, self.known = self.known, dict(self.frequent)
        keys = keys - self.known.keys()
        for k in keys & self.older.keys():
            self.known[k] = self.older[k]
        new = list(keys - self.older.keys())
        # encode() puts a space mark in front; before a line end that mark is a token of its own and not part of the key
        self.known.update((k, len(ids) - (k[0] == "\n")) for k, ids in zip(new, self.model.encode(new, num_threads=1), strict=True))

    def length(self, key: str) -> int:
        """Tokens of one key."""
        self.learn({key})
        return self.known[key]

    def spaces(self, k: int) -> int:
        """Tokens of ``k`` space marks that no word follows."""
        return 1 if k == 1 else self.length(" " * (k - 1)) if k else 0

    def _runs(self, keys: list[str]) -> int:
        """Tokens where spaces come in runs: a run belongs to the word that follows it."""
        n = run = 0
        for key in keys:
            if not key:
                run += 1
            elif key[0] == "\n":
                n += self.spaces(run) + self.length(key)
                run = 0
            else:
                n += self.length(" " * run + key)
                run = 0
        return n + self.spaces(run)

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, as the library encodes them."""
        keys = list(map(pre_tokens, texts))
        plain = ["" not in k for k in keys]
        self.learn(set().union(*(k for k, p in zip(keys, plain, strict=True) if p)))
        get = self.known.__getitem__
        n = [sum(map(get, k)) if p else 0 for k, p in zip(keys, plain, strict=True)]
        return [m if p or not t else self._runs(k) for m, p, t, k in zip(n, plain, texts, keys, strict=True)]


_WORKER: dict[str, Lengths] = {}


def _lengths(model: str, frequent: dict[str, int], key: str) -> Lengths:
    """The worker's lookup; it lives as long as the Python worker, across tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(model, frequent)
    return _WORKER[key]


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``TEXT_TOP`` most frequent pre-tokens of each text, with their counts."""
    for batch in batches:
        top = [[(k, n) for k, n in Counter(pre_tokens(t or "")).most_common(TEXT_TOP) if 0 < len(k) <= 64] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in x] for x in top], pa.list_(pa.string())), pa.array([[n for _, n in x] for x in top], pa.list_(pa.int64()))], names=["keys", "counts"])


def frequent_lengths(docs: DataFrame, model: str, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the ``size`` most frequent pre-tokens in the first ``SAMPLE_TEXTS`` texts that Spark reads.

    Reads no further than it must (``take``), whatever the size of ``docs``. Which texts these are plays no part in the
    counts, as any other pre-token is encoded where it occurs.
    """
    seen: Counter[str] = Counter()
    for row in docs.select(F.col(text).alias("text")).mapInArrow(light(_top), "keys array<string>, counts array<bigint>").take(SAMPLE_TEXTS):
        seen.update(dict(zip(row["keys"], row["counts"], strict=True)))
    keys = [k for k, _ in seen.most_common(size)]
    lengths = Lengths(model, {})
    lengths.learn(set(keys))
    return {k: lengths.known[k] for k in keys}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, frequent: dict[str, int] | None = None) -> DataFrame:
    """Return doc_id, n_bytes long, n_tokens long, over_limit boolean: one row per input row, repeated rows included.

    ``model``: file of a sentencepiece BPE model, readable on every executor. ``frequent``: the first tier; taken from
    ``docs`` if None. A model with pieces that cross borders of pre-tokens is refused. A null text counts as empty (0 bytes, 0 tokens). Null ids pass through. Texts of any length are
    counted whole. Other columns of ``docs``, whatever their names, are neither read nor returned. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if frequent is None:
        frequent = frequent_lengths(docs, model, text)
    table = spark.sparkContext.broadcast(frequent)
    key = f"{model}:{table.id if hasattr(table, 'id') else id(table)}:{len(frequent)}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model, table.value, key)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [x for i in range(0, len(texts), 512) for x in lengths.count_batch(texts[i : i + 512])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("row"), "text")
    counted = whole.mapInArrow(light(count), f"doc_id struct<doc_id:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
