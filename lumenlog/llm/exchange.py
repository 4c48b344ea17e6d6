"""Packed exchanges between chunks of documents and the parts of a key space.

Documents are dealt into chunks of a few MB by a hash. A chunk sends each
distinct key once, packed with the keys of the same part into one binary row;
so a key that every document holds costs a part one entry per chunk, not one per
document. Parts answer with rows addressed to chunks. The numbers of chunks, of
parts and of tasks follow the bytes of text, so either side's memory stays bounded
and no task's share grows with the input. Rows alike in doc_id and text are to be
folded first (``common.folded``), as a hash can't part them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_BYTES = 16 << 20
#: Bytes of text that one task sees, chunk by chunk; more of them where tasks would pass ``MOST_TASKS``.
TASK_BYTES = 32 << 20
MOST_TASKS = 100_000


def counts_for(total: int, chunk_bytes: int) -> tuple[int, int]:
    """Chunks and parts for so many bytes of text."""
    return max(1, -(-total // chunk_bytes)), max(12, -(-total // PART_BYTES))


def tasks_for(total: int) -> int:
    """Tasks for so many bytes of text."""
    return max(1, min(-(-total // TASK_BYTES), max(MOST_TASKS, -(-total // (8 * TASK_BYTES)))))


def chunked(docs: DataFrame, chunks: int, rest: bool = False, more: tuple[Column, ...] = ()) -> DataFrame:
    """(chunk, doc_id, raw, times if ``docs`` has it): whole texts as UTF-8 bytes (null: empty), dealt by a hash of the row.

    ``more`` columns go with them; ``rest``: a struct of all columns of ``docs`` but the text goes with them.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    more = [*more, F.col("times")] if "times" in docs.columns else list(more)
    more += [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "times")]).alias("rest")] if rest else []
    return docs.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(chunks)).alias("chunk"), "doc_id", raw.alias("raw"), *more)


def split(part: np.ndarray, parts: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays of each part that has any, in their order; work doesn't depend on how many parts there are."""
    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.int64), kind="stable")
    names, starts, ends = bounds(part[order])
    arrays = [a[order] for a in arrays]
    for p, at, to in zip(names, starts, ends):
        yield p, [a[at:to] for a in arrays]


def bounds(part: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(parts, starts, ends) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[at].tolist(), at.tolist(), np.append(at[1:], len(part)).tolist() if len(at) else []


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def unpack(blob, dtype) -> np.ndarray:
    return np.frombuffer(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob, dtype)


def pack_keys(keys: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys as differences of as few bytes as the widest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpack_keys(blob: bytes, width: int) -> np.ndarray:
    some = np.frombuffer(blob, np.uint8).reshape(-1, width)
    gaps = np.zeros((len(some), 8), np.uint8)
    gaps[:, :width] = some
    return np.cumsum(gaps.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count; those of 255 and above follow in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def unpack_counts(small: bytes, big: bytes) -> np.ndarray:
    n = np.frombuffer(small, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(big, np.int64)
    return n


def distinct(values: np.ndarray, parts: int):
    """Distinct values in the order of (part, value), where each value is among them, and the bounds of parts that have any."""
    u, where = np.unique(values, return_inverse=True)
    part = part_of(u, parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.int64), kind="stable")
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[where], bounds(part[order])
