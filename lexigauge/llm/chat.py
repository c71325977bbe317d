r"""Chat formatting from event logs.

A log holds, per conversation and in order of seq, the events of its messages: ``message`` (a whole text), ``delta`` (text
to append), ``edit`` (the text is replaced) and ``regenerate`` (the text starts again). They are folded per message, then
rendered turn by turn:

    ### Role: text </turn>\n

Texts are escaped so that no control string can appear in them: a backslash is put before every ``#`` of ``###``, before
``</turn>`` and before backslashes themselves, which makes rendering reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light

#: Marks of the template: before the role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_SPECIAL = re.compile(r"\\|###|</turn>")
#: Characters of a text that are in hand at once when it is read back.
PIECE = 1 << 20


def escape(text: str) -> str:
    """A backslash before every backslash, ``###`` and ``</turn>``."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def pieces(text: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """Undo ``escape`` between two places, in pieces of at most PIECE characters: a text of any length costs no more."""
    end = len(text) if end is None else end
    while start < end:
        cut = text.find("\\", start, min(end, start + PIECE))
        stop = cut if cut >= 0 else min(end, start + PIECE)
        if stop > start:
            yield text[start:stop]
        start = stop
        if cut >= 0:  # what follows the backslash stands for itself
            yield text[cut + 1 : cut + 2]
            start = cut + 2


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return "".join(pieces(text)) if "\\" in text else text


def event_log(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a log: conv_id, message_id, seq, role, kind, text.

    It gives logs to tables that hold finished turns only. By the CRC of its text a message is streamed in two halves,
    or drafted, regenerated and streamed, or drafted and edited. A message ends only after the next turn has begun, so
    the messages of a conversation interleave. seq follows turn, then role and text, so that repeated rows and ties of
    turn keep a defined order; null texts count as empty, and an empty table gives an empty log.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    half = (F.length(body) / 2).cast("int")
    first, second = F.substring(body, F.lit(1), half), F.substring(body, half + 1, F.length(body))
    ways = [
        [("message", first), ("delta", second)],
        [("message", F.lit("draft")), ("regenerate", F.lit("")), ("delta", first), ("delta", second)],
        [("message", F.lit("draft")), ("delta", F.lit(" of it")), ("edit", body)],
    ]
    logs = [F.array(*[F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), piece.alias("piece")) for step, (kind, piece) in enumerate(way)]) for way in ways]
    # a row's message id must tell repeated rows apart: they are counted first, then numbered
    rows = conversations.select("conv_id", "turn", "role", body.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    message = F.struct("turn", "role", F.sha2(F.col("text"), 256).alias("mark"), "copy")
    way = F.crc32(F.col("text").cast("binary")) % len(ways)
    events = rows.withColumn("e", F.explode(F.when(way == 0, logs[0]).when(way == 1, logs[1]).otherwise(logs[2])))
    place = F.col("turn") * 2 + F.when(F.col("e.step") > 0, 3).otherwise(0)
    seq = F.struct(place.alias("place"), message.alias("m"), F.col("e.step").alias("step"))
    return events.select("conv_id", message.alias("message_id"), seq.alias("seq"), "role", F.col("e.kind").alias("kind"), F.col("e.piece").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, message_id, seq (of its first event), role, text.

    Folding a conversation's log in order of seq touches one message an event, and no event of another message changes
    it. So the log is partitioned by conversation and message, each part is sorted by seq and folded, and the messages
    are ordered by their first events: the same result as one walk over the whole log, while a conversation of any length
    is spread over tasks and a message is bounded by its own text. What precedes the last message, edit or regenerate event of a message is dropped,
    the rest is concatenated in order of seq. Repeated events (same seq, kind and text) count once. The role is that of
    the first event. Null texts count as empty; messages whose last such event is ``delete`` disappear. Other columns
    are neither read nor returned. An empty log gives an empty result.
    """
    pieces = F.array_sort(F.collect_set(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = events.groupBy("conv_id", "message_id").agg(F.min("seq").alias("seq"), F.min_by("role", "seq").alias("role"), pieces.alias("events"))
    starts = F.filter("events", lambda e: e["kind"] != "delta")
    since = F.when(F.size(starts) > 0, F.element_at(starts, -1)["seq"])
    last = F.when(F.size(starts) > 0, F.element_at(starts, -1)["kind"])
    live = F.filter("events", lambda e: since.isNull() | (e["seq"] >= since))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return grouped.where(last.isNull() | (last != "delete")).select("conv_id", "message_id", "seq", "role", text.alias("text"))


def escaped(text: Column) -> Column:
    """``escape`` as an expression."""
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, seq, formatted, loss (start and length of the trained text inside formatted).

    The concatenation of formatted in order of seq is the conversation; it is kept by turn, since one conversation may be
    larger than a task. Only texts of the role assistant are trained on: they carry the mask, as written, escapes
    included; other turns have a null mask. Null roles and texts are rendered as empty, texts of any length whole; null
    ids pass through. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), ":", r"\\:")
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    trained = F.coalesce(F.col("role") == "assistant", F.lit(False))
    loss = F.when(trained, F.struct(F.length(head).alias("start"), F.length(body).alias("length")))
    return messages.select("conv_id", "seq", F.concat(head, body, F.lit(CLOSE)).alias("formatted"), loss.alias("loss"))


def _unescaped(text: str, mark: str, start: int) -> int:
    """Where ``mark`` stands next behind an even number of backslashes; -1 if nowhere."""
    at = text.find(mark, start)
    while at >= 0:
        before = at
        while before > start and text[before - 1] == "\\":
            before -= 1
        if (at - before) % 2 == 0:
            return at
        at = text.find(mark, at + 1)
    return -1


def spans(formatted: str) -> Iterator[tuple[str, int, int]]:
    """Role, and start and end of the escaped text, of every rendered turn, without a copy of it.

    Within an escaped role every ``:`` has a backslash, within an escaped text every ``</turn>``, so the first marks
    without one end them. What is no turn raises a ValueError.
    """
    at = 0
    while at < len(formatted):
        middle = _unescaped(formatted, MIDDLE, at + len(OPEN)) if formatted.startswith(OPEN, at) else -1
        end = _unescaped(formatted, CLOSE, middle + len(MIDDLE)) if middle >= 0 else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        yield unescape(formatted[at + len(OPEN) : middle]), middle + len(MIDDLE), end
        at = end + len(CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    return [(role, unescape(formatted[start:end])) for role, start, end in spans(formatted)]


def digests(rendered: DataFrame) -> DataFrame:
    """Read conversations back from their rendered turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The turns of a conversation stream in order through one task: a digest over a whole conversation has to see it in
    order. A turn is read in pieces of PIECE characters, so besides the batch that holds it a turn of any length costs a few
    MB. Ids may be of any type; rows with a null id are one conversation. An empty table
    gives an empty result.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, n, chars, total, started = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):  # one row's text at a time
                conv, formatted, start, length = (x.as_py() for x in row)
                if started and conv != now:
                    out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                if not started or conv != now:
                    now, turns, loss, n, chars, total, started = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                for role, begin, end in spans(formatted):
                    turns.update(f"{role}\n".encode())
                    for piece in pieces(formatted, begin, end):
                        turns.update(piece.encode())
                    turns.update(b"\n")
                    n += 1
                if start is not None:
                    for piece in pieces(formatted, start, start + length):
                        loss.update(piece.encode())
                        chars += len(piece)
                total += len(formatted)
            yield table(out, batch.schema.field(0).type)
        if started:
            yield table([(now, n, turns.hexdigest(), chars, loss.hexdigest(), total)], batch.schema.field(0).type)

    def table(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        kinds = (of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = rendered.select("conv_id", "seq", "formatted", F.col("loss.start").alias("start"), F.col("loss.length").alias("length"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "formatted", "start", "length")
    return rows.mapInArrow(light(read), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
