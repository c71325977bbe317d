"""Fill-in-middle: documents are cut into prefix, middle and suffix, and the middle goes to the end.

The text of a document is one buffer: sentinels are inserted at its cuts, then two neighbouring blocks change places by
three reversals. The same rotation, of blocks found by their sentinels, brings the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, slices, small_batches


@dataclass(frozen=True)
class Plan:
    """Who is cut, how, and by which marks: ``rate`` of 100 documents are cut, ``spm`` of 100 of these suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """The sentinels in UTF-8. A mark's first byte may stand nowhere else in a mark: then no mark can arise between
        a text without marks and a mark beside it, and the three are found again for certain."""
        marks = tuple(m.encode() for m in (self.prefix, self.suffix, self.middle))
        if any(not m or any(m[0] in x[1:] for x in marks) or any(m is not x and x.startswith(m) for x in marks) for m in marks):
            raise ValueError(f"marks {marks} could be mistaken for each other")
        return marks


def exchange(buffer: bytearray, start: int, at: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, at) and [at, end): reverse each, then both together."""
    for i, j in ((start, at), (at, end), (start, end)):
        buffer[i:j] = buffer[i:j][::-1]


def draws(seed: int, doc_id: int | str | None) -> tuple[int, int, int, int]:
    """Four unsigned integers from the SHA-256 of ``seed:doc_id``; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def line_ends(data: bytes) -> np.ndarray:
    """Offsets behind every line; the last one may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data[-1] == 10 else np.append(ends, len(data))


def transform(data: bytes, doc_id: int | str | None, plan: Plan, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and output of one text."""
    ends = line_ends(data)
    n = len(ends)
    one, two, cut, order = draws(plan.seed, doc_id)
    if not n or cut % 100 >= plan.rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, suffix, middle = marks
    buffer = bytearray(data)
    for at, mark in ((b, suffix), (a, middle), (0, prefix)):
        buffer[at:at] = mark
    second, third = a + len(prefix), b + len(prefix) + len(middle)
    spm = order % 100 < plan.spm
    exchange(buffer, 0 if spm else second, third, len(buffer))
    return n, "spm" if spm else "psm", len(data[:a].decode()), len(data[a:b].decode()), bytes(buffer)


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output: the rotation back, then the sentinels go."""
    if form == "plain":
        return output
    prefix, suffix, middle = marks
    buffer = bytearray(output)
    p, s, m = (buffer.index(x) for x in (prefix, suffix, middle))
    if form == "spm":  # suffix, then prefix and middle
        exchange(buffer, s, p, len(buffer))
        m -= p - s
        p = s
    else:  # behind the prefix: suffix, then middle
        exchange(buffer, s, m, len(buffer))
        m = s
    s = buffer.index(suffix, m)
    for at, mark in ((s, suffix), (m, middle), (p, prefix)):
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Return doc_id, n long, form string, prefix_chars long, middle_chars long, output string: one row per row of ``docs``.

    ``docs``: doc_id, text. Lines are the units; prefix, middle and suffix are runs of whole lines and may be empty. Null
    texts are empty; empty texts and texts that hold a sentinel stay as they are (``plain``: no counts). Rows with equal
    ids are cut by the same draws, rows with a null id as if it were empty. Other columns are neither read nor returned.
    An empty table gives an empty result. A text costs about three times its bytes while it is in work.
    """
    plan = plan or Plan()
    marks = plan.marks()
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                done = [transform(t.as_buffer().to_pybytes(), i.as_py(), plan, marks) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
                n, form, prefix, middle, output = zip(*done, strict=True) if done else ((),) * 5
                arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(light(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(formed: DataFrame, plan: Plan | None = None) -> DataFrame:
    """All columns of ``formed`` and restored string: the text rebuilt from the columns output and form alone."""
    marks = (plan or Plan()).marks()
    names = [*formed.columns, "restored"]
    out, form = formed.columns.index("output"), formed.columns.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, out):
                texts = [restore(t.as_buffer().to_pybytes(), f.as_py(), marks) for t, f in zip(batch.column(out), batch.column(form), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return formed.mapInArrow(light(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema) + ", restored string")


def fim_digests(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and restored text of every row."""
    both = restored(fill_in_middle(docs, plan), plan)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
