"""Chat formatting from event logs.

A log holds events (conv_id, seq, kind, msg, role, text) in any order. Sorted by
seq they are folded into final messages: ``message`` opens a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it for the deltas
that follow, ``delete`` takes it away. Events are dealt by conversation once and
sorted by message, which Spark spills where it must; messages are folded one
after another, sorted by their first seq and rendered in one stream that holds one
message at a time. So a conversation with a third of all events needs one task's
time, as its digest does, but no more memory than another. A rendered
conversation comes in parts of about
``PART_CHARS`` characters with the spans under the loss mask (assistant texts).

The template marks turns with ``<|im_start|>`` and ``<|im_end|>``. Inside roles and
texts every ``<|`` gets a backslash between its characters, one more if some stand
there already, which ``unescape`` undoes; so control strings never come from data.

Edge cases: a null text is empty and a null role is an empty role; events of one
seq are ordered by kind, msg, role and text, nulls first; deltas or edits without
an open message open one; repeated rows are repeated events; an empty log gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_CHARS = 1 << 20
KINDS = ("message", "delta", "edit", "regenerate", "delete")

_OPENERS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPENERS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str | None) -> str:
    """A role on one line: backslashes and line feeds are written out, control strings escaped."""
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Events (conv_id, msg, seq, kind, role, text), in order -> messages (conv_id, seq, role, text)."""
    now: list | None = None
    for conv, msg, seq, kind, role, text in events:
        text = text or ""
        if now and (now[0], now[1]) == (conv, msg) and kind != "message":
            if kind == "delta":
                now[4].append(text)
            elif kind == "edit":
                now[4] = [text]
            elif kind == "regenerate":
                now[4] = [text] if text else []
            elif kind == "delete":
                now = None
            continue
        if now:
            yield now[0], now[2], now[3], "".join(now[4])
        now = None if kind == "delete" else [conv, msg, seq, role or "", [text]]
    if now:
        yield now[0], now[2], now[3], "".join(now[4])


def render(messages: Iterator[tuple]) -> Iterator[tuple]:
    """Messages in order -> (conv_id, part, formatted, spans, last): spans are character ranges in ``formatted``."""
    conv, part, size, out, spans, begun = None, 0, 0, [], [], False
    for c, _, role, text in messages:
        if begun and (c != conv or size >= PART_CHARS):
            yield conv, part, "".join(out), spans, c != conv
            part, size, out, spans = (part + 1 if c == conv else 0), 0, [], []
        conv, begun = c, True
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
        turn = f"{head}{body}{END}\n"
        out.append(turn)
        size += len(turn)
    if begun:
        yield conv, part, "".join(out), spans, True


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) pairs of a rendered part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        yield _unrole(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += sum(len(x) for x in r if isinstance(x, str))
        if len(some) >= size or held >= chars:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in some], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in some], schema=schema)


_MESSAGES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("spans", _SPANS), ("last", pa.bool_())])
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def conversations(events: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, spans, last) of every conversation, its parts in order within one partition."""
    rank = F.element_at(F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))]), F.col("kind"))
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "msg", F.col("seq").cast("long").alias("seq"), "kind", "role", "text", rank.alias("rank"))
    parts = log.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "seq", "rank", "role", "text").drop("rank")
    done = parts.mapInArrow(lambda b: _batches(fold(_rows(b)), _MESSAGES), "conv_id long, seq long, role string, text string")
    return done.sortWithinPartitions("conv_id", "seq", "role", "text").mapInArrow(
        lambda b: _batches(render(_rows(b)), _PARTS), "conv_id long, part long, formatted string, spans array<struct<start: long, end: long>>, last boolean"
    )


def digest(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Rendered parts in order, read back -> one row of figures per conversation."""
    fresh = True
    for conv, _, formatted, spans, last in parts:
        if fresh:
            n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for role, text in parse(formatted):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        for s in spans:
            text = unescape(formatted[s["start"] : s["end"]])
            loss.update(text.encode())
            loss_chars += len(text)
        chars += len(formatted)
        fresh = last
        if last:
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def digests(events: DataFrame) -> DataFrame:
    """Figures of every conversation, read back from its rendered parts."""
    return conversations(events).mapInArrow(
        lambda b: _batches(digest(_rows(b)), _DIGEST), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log by which a chat comes about: each turn in four events or five.

    A turn opens empty and gets its text in two deltas. Before that, an assistant's turn holds a draft
    that is regenerated; another's text is spoilt by a delta at the end and put right by an edit.
    Each row is a message of its own, repeated rows and rows of one turn too; rows without a turn come first.
    """
    text, half = F.coalesce(F.col("text"), F.lit("")), F.floor(F.char_length(F.coalesce(F.col("text"), F.lit(""))) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))

    def event(n: int, kind: str, said: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), said.alias("text"))

    none = F.lit("")
    made = F.when(F.col("role") == "assistant", F.array(event(0, "message", none), event(1, "delta", F.lit("draft")), event(2, "regenerate", none), event(3, "delta", first), event(4, "delta", rest)))
    made = made.otherwise(F.array(event(0, "message", none), event(1, "delta", first), event(2, "delta", F.lit("typo")), event(3, "edit", text)))
    start = F.coalesce(F.col("turn").cast("long") * 8, F.lit(-(1 << 62)))
    # The number of a row only ties its events together: all come from one row in one task, and order is by seq.
    rows = turns.select("conv_id", start.alias("start"), "role", "text", F.monotonically_increasing_id().cast("string").alias("msg"))
    each = rows.select("conv_id", "start", "msg", "role", F.explode(made).alias("e"))
    return each.select("conv_id", (F.col("start") + F.col("e.n")).alias("seq"), F.col("e.kind").alias("kind"), "msg", "role", F.col("e.text").alias("text"))
