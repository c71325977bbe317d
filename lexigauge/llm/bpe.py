"""Byte-level BPE on length-bucketed, padded numpy matrices.

Each pre-token is a row of token ids. In a round every row finds its leftmost pair of minimum rank through a hash table
of pairs, merges it, and rows without a mergeable pair leave (compaction). Rows of like length share a matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, slices, small_batches

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; a longer row, whose rounds would cost its square, runs alone (see ``_long``). Cells of a matrix;
#: entries of a worker's caches. Bytes of text encoded at once.
WIDTHS, CELLS, CACHE_SIZE = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048, 4096), 1 << 18, 40_000
SLICE = 1 << 20


class Pairs:
    """Hash table (left id, right id) -> merged id, open addressing with linear probing, looked up by whole arrays."""

    def __init__(self, vocabulary: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in vocabulary.items():
            for i in range(1, len(token)):
                a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(10, int(len(key) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):  # place one key per free slot, the rest move on by one
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.values[at[put]] = key[put], np.array(merged, np.int32)[put]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, ``NONE`` where the pair does not merge."""
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(left.shape)


class Encoder:
    """Encodes pre-tokens by the ranks of a vocabulary file, and whole texts by a splitting pattern."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE_SIZE):
        ranks = vocabulary(path)
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Pairs(ranks)
        self.split = regex.compile(pattern)
        self.bound = cache
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # ---- pre-tokens -------------------------------------------------------------------------------------------------
    def _matrix(self, tokens: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, padded; each round merges the leftmost pair of minimum rank of every row that is left.

        Returns the rows as they end, padded to the given width, and their lengths.
        """
        ended, lengths = tokens.copy(), length.copy()
        row, cols = np.arange(len(tokens)), np.arange(tokens.shape[1])
        rank = np.full(tokens.shape, NONE, np.int32)
        rank[:, :-1] = np.where(cols[1:] < length[:, None], self.pairs.ranks(tokens[:, :-1], tokens[:, 1:]), NONE)
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                ended[row[done], : tokens.shape[1]], lengths[row[done]] = tokens[done], length[done]
                keep = ~done
                row, tokens, rank, length, at, best = row[keep], tokens[keep], rank[keep], length[keep], at[keep], best[keep]
                if not len(row):
                    break
                width = int(length.max())
                tokens, rank, cols = tokens[:, :width], rank[:, :width], cols[:width]
            each, last = np.arange(len(row)), tokens.shape[1] - 1
            take = np.minimum(cols + (cols > at[:, None]), last)
            tokens, rank = np.take_along_axis(tokens, take, 1), np.take_along_axis(rank, take, 1)
            tokens[each, at] = best
            length = length - 1
            rank[each, length - 1] = NONE
            go = at + 1 < length
            rank[each[~go], at[~go]] = NONE
            rank[each[go], at[go]] = self.pairs.ranks(tokens[each[go], at[go]], tokens[each[go], at[go] + 1])
            go = at > 0
            rank[each[go], at[go] - 1] = self.pairs.ranks(tokens[each[go], at[go] - 1], tokens[each[go], at[go]])
        return ended, lengths

    def _long(self, tokens: np.ndarray) -> np.ndarray:
        """One long row. A round merges all non-overlapping pairs of the minimum rank, from the left.

        That equals one merge at a time unless a merge creates a pair of lower rank; then the round stops at that merge.
        """
        while len(tokens) > 1:
            rank = self.pairs.ranks(tokens[:-1], tokens[1:])
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping pairs (runs of one token) every second one merges
                new = np.empty(len(at), bool)
                new[0], new[1:] = True, at[1:] - at[:-1] > 1
                start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            kept = np.ones(len(tokens), bool)
            kept[at + 1] = False
            merged = tokens.copy()
            merged[at] = best
            after = merged[kept]
            if len(at) > 1 and len(after) > 1 and self.pairs.ranks(after[:-1], after[1:]).min() < best:
                kept[at[1:] + 1] = True
                merged[at[1:]] = tokens[at[1:]]
                after = merged[kept]
            tokens = after
        return tokens

    def encode_pre_tokens(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for width in WIDTHS:
            bucket = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in (bucket[i : i + CELLS // width] for i in range(0, len(bucket), CELLS // width)):
                raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(-1, width)
                ids, lengths = self._matrix(self.bytes_[raw], sizes[part])
                flat = ids[np.arange(width) < lengths[:, None]].astype("<u4").tobytes()
                ends = (np.cumsum(lengths) * 4).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
            low = width
        for i in np.flatnonzero(sizes > low):
            out[i] = self._long(self.bytes_[np.frombuffer(pieces[i], np.uint8)]).astype("<u4").tobytes()
        return out

    # ---- texts ------------------------------------------------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, as ``encode_ordinary`` of tiktoken gives them.

        What a pre-token encodes to is remembered in two generations: when the newer one is full it becomes the older,
        and what is still in use moves back from there.
        """
        pieces = list(map(self.split.findall, texts))
        need = set().union(*pieces)
        if len(self.known) > self.bound:
            self.older, self.known = self.known, {}
        need -= self.known.keys()
        for p in need & self.older.keys():
            self.known[p] = self.older[p]
        new = list(need - self.older.keys())
        self.known.update(zip(new, self.encode_pre_tokens([p.encode() for p in new]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def vocabulary(path: str) -> dict[bytes, int]:
    """Token -> rank of a ranks file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_WORKER: dict[tuple, Encoder] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker; built once, used by all its tasks."""
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Encoder(path, pattern)
    return _WORKER[path, pattern]


def forget() -> None:
    """Empty the caches of this worker's encoders; their tables stay."""
    for own in _WORKER.values():
        own.known, own.older = {}, {}


def tokens(path: str) -> dict[int, bytes]:
    """Rank -> token, read once per Python worker."""
    if path not in _TOKENS:
        _TOKENS[path] = {b: a for a, b in vocabulary(path).items()}
    return _TOKENS[path]


def decode(ids: np.ndarray, known: dict[int, bytes]) -> bytes:
    """Bytes of a sequence of ids."""
    return b"".join(map(known.__getitem__, ids.tolist()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id and ids array<int>: one row per input row, repeated rows included.

    ``path``: ranks file (base64 token and rank per line) that every executor can read. ``pattern``: splits a text into
    pre-tokens. Null texts count as empty and give an empty array; null ids pass through; texts of any length are
    encoded whole. Other columns are neither read nor returned. An empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(light(encode, forget), f"doc_id {kind}, ids array<int>")


def bpe_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode texts and decode the ids again in one pass: doc_id, n_tokens long, ids_sha256, decoded_sha256 string.

    One row per input row; the same as ``bpe_decode(bpe_encode(...), digests=True)``, but ids and bytes stay in the worker.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = encoder(path, pattern), tokens(path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                marks = [hashlib.sha256(x).hexdigest() for x in ids]
                raw = [hashlib.sha256(decode(np.frombuffer(x, "<u4"), known)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(marks, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(light(of, forget), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_decode(encoded: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Decode the ``ids`` of ``bpe_encode``: doc_id, n_tokens long, ids_sha256 string, and decoded binary.

    With ``digests`` the decoded bytes are replaced by decoded_sha256, so that they need not leave the worker. A null or
    empty array decodes to no bytes. One row per input row, repeats and null ids included; an empty table gives an empty
    result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(path)
        for whole in batches:
            for batch in slices(whole, 1):
                column = batch.column(1)
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                n, marks, raw = [], [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    ids = values[a:b]
                    n.append(b - a)
                    marks.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text = decode(ids, known)
                    raw.append(hashlib.sha256(text).hexdigest() if digests else text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.string()), pa.array(raw, pa.string() if digests else pa.binary())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256" if digests else "decoded"],
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(light(of), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, {'decoded_sha256 string' if digests else 'decoded binary'}")
