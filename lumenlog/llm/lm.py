"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes three estimates, the
bigram and unigram maximum-likelihood estimates and the add-one unigram:
``w2 * c(h, t) / c(h) + w1 * c(t) / N + w0 * (c(t) + 1) / (N + V + 1)``. The
weights depend on how often the predecessor was seen (buckets of powers of two)
and are learned by expectation-maximisation on deleted counts: each training
token is held out in turn, its own occurrence taken from every count.

Counts cover all training documents and are exact but for chance collisions of 64-bit
hashes of tokens and pairs (n distinct ones have about n * n / 2^65: under one in 30 million for a
million). Rows alike in doc_id and text are counted as one row with a number. Chunks of documents send
their distinct tokens and pairs (as 64-bit hashes) to the parts of the key space
once each, with the chunk's training counts; a part adds them up and answers in
the order asked, so no keys travel back. A pair in a third of all documents
costs a part one entry per chunk. What expectation-maximisation needs is added up
in a grid of ``BUCKETS`` x ``GRID`` x ``GRID`` cells, whose size doesn't depend on
the corpus; only that grid and two totals reach the driver.

Edge cases: null and empty texts have one token, the end; the first token
follows an end; with no training documents N and V are 0 and every score is 0
per token; repeated rows count and are scored each; extra columns are not read;
a null doc_id counts as an empty text for its fold; a very long text is one chunk's
work, as its tokens, several times its size in memory.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import cut, folded, text_bytes, unfolded
from lumenlog.llm.exchange import chunked, distinct, pack_counts, pack_keys, tasks_for, unpack_counts, unpack_keys
from lumenlog.llm.hashing import mix64, span_hashes, word_spans

FOLDS = 7
HELD_OUT = 2
CHUNK_BYTES = 8 << 20
PART_BYTES = 24 << 20
BUCKETS = 40
#: Logarithms are kept in eighths of a power of two.
FINE = 8
GRID = 40 * FINE
ROUNDS = 30

_U = np.uint64
_END = np.array([0x5BD1E995A7C4F1E3], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASK = {"part": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "wide": pa.int32(), "counts": pa.binary(), "big": pa.binary()}
_SAY = {"part": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "counts": pa.binary(), "big": pa.binary(), "n": pa.int64(), "v": pa.int64()}
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {_KINDS[v]}" for k, v in schema.items())


def fold(doc_id: int | None, folds: int = FOLDS) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class Tokens:
    """The token and pair hashes of a chunk's documents, an end after each document."""

    def __init__(self, t: pa.Table):
        raws = t["raw"].to_pylist()
        self.ids = t["doc_id"]
        self.held = np.array([fold(i) == HELD_OUT for i in self.ids.to_pylist()], bool)
        text = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
        ends = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64))
        del raws
        a, b = word_spans(text)
        words = span_hashes(text, a, b)
        doc = np.searchsorted(ends, a, side="right")
        size = np.bincount(doc, minlength=len(ends))
        self.size = size + 1
        self.end = np.cumsum(self.size)
        self.token = np.empty(len(words) + len(ends), _U)
        self.token[self.end - 1] = _END[0]
        self.token[np.arange(len(words)) + doc] = words
        self.doc = np.repeat(np.arange(len(ends)), self.size)
        before = np.empty_like(self.token)
        before[:1] = _END[0]
        before[1:] = self.token[:-1]
        self.pair = mix64(before * _U(0x9E3779B97F4A7C15) + self.token)
        self.times = t["times"].to_numpy().astype(np.int64)
        #: How often each token counts for training: not at all in held-out documents.
        self.trains = np.where(self.held, 0, self.times)[self.doc]


def _ask(parts: int):
    schema = pa.schema(list(_ASK.items()))

    def run(key, t):
        x, rows = Tokens(t), []
        for kind, values in ((1, x.token), (2, x.pair)):
            u, where, runs = distinct(values, parts)
            n = np.bincount(where, weights=x.trains, minlength=len(u)).astype(np.int64)
            for p, a, b in zip(*runs):
                keys, width = pack_keys(u[a:b])
                counts, big = pack_counts(n[a:b])
                rows.append({"part": p, "chunk": key[0].as_py(), "kind": kind, "keys": keys, "wide": width, "counts": counts, "big": big})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


def _add(key, t):
    sets = [unpack_keys(k, w) for k, w in zip(t["keys"].to_pylist(), t["wide"].to_pylist())]
    counts = [unpack_counts(c, b) for c, b in zip(t["counts"].to_pylist(), t["big"].to_pylist())]
    sizes = [len(s) for s in sets]
    u, where = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
    first, rows, at = True, [], 0
    kind = key[1].as_py()
    for chunk, n in zip(t["chunk"].to_pylist(), sizes):
        small, big = pack_counts(total[where[at : at + n]])
        own = (int(total.sum()), int(np.count_nonzero(total))) if first and kind == 1 else (0, 0)
        rows.append({"part": key[0].as_py(), "chunk": chunk, "kind": kind, "counts": small, "big": big, "n": own[0], "v": own[1]})
        first, at = False, at + n
    return pa.Table.from_pylist(rows, schema=pa.schema(list(_SAY.items())))


class Counted:
    """A chunk's tokens with their corpus counts: own, predecessor's and the pair's."""

    def __init__(self, left: pa.Table, right: pa.Table, parts: int):
        self.x = x = Tokens(left)
        got = {1: {}, 2: {}}
        for p, kind, small, big in zip(*(right[c].to_pylist() for c in ("part", "kind", "counts", "big"))):
            got[kind][p] = unpack_counts(small, big)
        counts = {}
        for kind, values in ((1, x.token), (2, x.pair)):
            _, where, runs = distinct(values, parts)
            full = np.concatenate([got[kind][p] for p in runs[0]])
            counts[kind] = full[where]
        self.own, self.pair = counts[1], counts[2]
        self.before = np.empty_like(self.own)
        self.before[1:] = self.own[:-1]
        self.before[:1] = self.own[x.end[0] - 1]  # the first token follows an end


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen, then one for each power of two."""
    return np.minimum(np.frexp(count.astype(float))[1], BUCKETS - 1)


def _level(count: np.ndarray) -> np.ndarray:
    """Counts as steps of an eighth of a power of two; 0 stays 0."""
    return np.where(count > 0, np.minimum(1 + np.round(FINE * np.log2(np.maximum(count, 1))), GRID - 1), 0).astype(np.int64)


_CELLS = {"cell": pa.int64(), "n": pa.int64()}


def _grid(parts: int):
    schema = pa.schema(list(_CELLS.items()))

    def run(key, left, right):
        if not left.num_rows:
            return schema.empty_table()
        c = Counted(left, right, parts)
        on = c.x.trains > 0
        # One occurrence is held out: it leaves the token's, the pair's and the predecessor's counts.
        own, pair, before = c.own[on] - 1, c.pair[on] - 1, c.before[on] - 1
        ratio = np.where(pair > 0, 1 + np.minimum(np.round(FINE * np.log2(np.maximum(before, 1) / np.maximum(pair, 1))), GRID - 2), 0).astype(np.int64)
        cell, where = np.unique((bucket(before) * GRID + ratio) * GRID + _level(own), return_inverse=True)
        n = np.bincount(where, weights=c.x.trains[on], minlength=len(cell)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(cell), pa.array(n)], schema=schema)

    return run


def weights(cells: np.ndarray, n: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Weights (bigram, unigram, add-one) of each bucket by expectation-maximisation over the grid."""
    out = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    own = cells % GRID
    ratio = cells // GRID % GRID
    at = cells // (GRID * GRID)
    count = np.where(own > 0, 2.0 ** ((own - 1) / FINE), 0.0)
    p = np.stack([np.where(ratio > 0, 2.0 ** (-(ratio - 1) / FINE), 0.0), count / max(1, total - 1), (count + 1) / (total + kinds)], axis=1)
    # Sparse buckets lean on one shared estimate, worth a hundred tokens.
    for b in (None, *range(BUCKETS)):
        mine = np.ones(len(at), bool) if b is None else at == b
        if b is not None:
            out[b] = shared * [1.0, 1.0, 1.0]
        if mine.any():
            w = np.array([1 / 3, 1 / 3, 1 / 3])
            for _ in range(ROUNDS):
                share = w * p[mine]
                share /= share.sum(axis=1, keepdims=True)
                mass = (share * n[mine, None]).sum(axis=0) + (0.01 if b is None else 100.0 * shared)
                w = mass / mass.sum()
            if b is None:
                shared = w
            else:
                out[b] = w
        elif b is None:
            shared = np.array([0.0, 0.5, 0.5])
    # An unseen predecessor has no bigrams: its weight goes to the other two.
    out[0] = np.array([0.0, out[0, 1], out[0, 2]]) / max(1e-12, out[0, 1] + out[0, 2])
    return out


_SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "times": pa.int64()}


def _score(parts: int, total: int, kinds: int, mix: np.ndarray):
    schema = pa.schema(list(_SCORES.items()))

    def run(key, left, right):
        if not left.num_rows:
            return schema.empty_table()
        c = Counted(left, right, parts)
        x = c.x
        plain = (c.own + 1) / (total + kinds + 1)
        w = mix[bucket(c.before)]
        p = w[:, 0] * c.pair / np.maximum(c.before, 1) + w[:, 1] * c.own / max(1, total) + w[:, 2] * plain
        at = x.end - x.size
        known = np.add.reduceat((c.own > 0).astype(np.int64), at)
        base, score = np.add.reduceat(np.log10(plain), at), np.add.reduceat(np.log10(p), at)
        n = len(at)
        return pa.Table.from_arrays(
            [x.ids.combine_chunks(), pa.array(x.held), pa.array(x.size), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score), pa.array(x.times)], schema=schema
        )

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = folded(docs.select("doc_id", "text"))
    total_bytes = text_bytes(docs)
    parts, tasks = max(12, -(-total_bytes // PART_BYTES)), tasks_for(total_bytes)
    texts = chunked(docs, max(1, -(-total_bytes // CHUNK_BYTES))).repartition(tasks, "chunk")
    asked = texts.groupBy("chunk").applyInArrow(_ask(parts), _ddl(_ASK))
    said = cut(asked.repartition(parts, "part", "kind").groupBy("part", "kind").applyInArrow(_add, _ddl(_SAY)))
    sums = said.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"] or 0)
    answers = said.select("part", "chunk", "kind", "counts", "big")
    both = texts.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
    grid = both.applyInArrow(_grid(parts), _ddl(_CELLS)).groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    mix = weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(float), total, kinds)
    return unfolded(both.applyInArrow(_score(parts, total, kinds, mix), _ddl(_SCORES)), docs)
