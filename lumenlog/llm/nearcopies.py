"""Near-dedup of whole texts at a five-word similarity: SimHash blocks, completed by an exact set join.

Words are those of ``simhash``; a text's shingles are the set of its runs of
``SHINGLE`` words (fewer words: the whole sequence; none: the empty set). Two texts
are near copies where their shingles' Jaccard similarity is at least ``NUM / DEN``;
groups are the connected components of that relation.

SimHash fingerprints alone can't give that: at a similarity of 0.8 two
fingerprints differ in about 10 of 64 bits, and blocks for 10 or more differing bits
would hold almost all pairs. So fingerprints within ``BITS`` bits, found by
pigeonhole blocks, only propose pairs, and a prefix join over the sets finds the others:

1. Chunks of documents send their distinct shingles, as truncated hashes, to the parts of
   the key space, which answer in how many sets each stands (at least; at most 255).
   By that number, then by hash, all shingles are in one order. Any order gives
   the same result: rare shingles come first so that few texts share one.
2. Sets that are similar enough share one of their first
   ``n - ceil(n * NUM / DEN) + 1`` shingles. Only such of these as stand in another set
   too leave a chunk, with the set; texts without one have no near copy.
3. Texts that share such a shingle, or a SimHash component, are verified against the least of
   them on their whole sets. What that joins is one group.
4. Texts of different groups that share a shingle are paired where its place in
   both orders leaves enough shingles behind it; of the largest group at a shingle
   only pairs with other groups' texts are made. These pairs are verified too.

Sets are compared by 64-bit hashes of shingles.

Edge cases: texts with one set of shingles are one node, null and wordless texts
too; rows alike in doc_id and text are one row with a number; which row of a group stays is up to
``keep_one``; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import cut, folded, text_bytes
from lumenlog.llm.exchange import bounds, chunked, pack_counts, pack_keys, tasks_for, unpack_counts, unpack_keys
from lumenlog.llm.graph import components
from lumenlog.llm.hashing import mix64, span_hashes, word_spans
from lumenlog.llm.simhash import BITS, blocks_for, keep_one, links

SHINGLE = 5
NUM, DEN = 4, 5
CHUNK_BYTES = 8 << 20
PART_BYTES = 24 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASK = "part long, chunk long, keys binary, width int, counts binary, big binary"
_SAY = "part long, chunk long, counts binary, big binary"
_OUT = "doc_id long, h long, times long, node long, size int, fp long, prefix array<long>, at array<int>, toks array<long>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _mixed(h: np.ndarray, words: int, n: int) -> np.ndarray:
    """Hashes of the ``n`` runs of ``words`` consecutive word hashes."""
    out = np.full(n, words, _U)
    for k in range(words):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


class Sets:
    """The shingle sets of a chunk's documents: ``tok`` ascending within each document, ``of`` the document."""

    def __init__(self, raws: list[bytes], shingle: int = SHINGLE):
        n_docs = len(raws)
        text = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
        a, b = word_spans(text)
        h = span_hashes(text, a, b)
        ends = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64))
        doc = np.searchsorted(ends, a, side="right")
        words = np.bincount(doc, minlength=n_docs)
        last = np.cumsum(words)
        n = max(0, len(h) - shingle + 1)
        inside = doc[:n] == doc[len(h) - n :]
        few = np.flatnonzero((words > 0) & (words < shingle))
        tok = [_mixed(h, shingle, n)[inside], *[_mixed(h[last[d] - words[d] : last[d]], int(words[d]), 1) for d in few.tolist()]]
        of = np.concatenate([doc[:n][inside], few])
        tok = np.concatenate(tok)
        order = np.lexsort((tok, of))
        tok, of = tok[order], of[order]
        self.fp = self._fingerprints(tok, of, n_docs)
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (of[1:] != of[:-1])
        self.tok, self.of = tok[first], of[first]
        self.size = np.bincount(self.of, minlength=n_docs)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.node = np.array([xxhash.xxh3_64_intdigest(self.tok[x:y].tobytes()) for x, y in zip(self.start.tolist(), self.end.tolist())], _U).view(np.int64)
        # The first document of each set stands for it in this chunk.
        self.lead = np.zeros(n_docs, bool)
        self.lead[np.unique(self.node, return_index=True)[1]] = True
        self.lead &= self.size > 0
        self.mine = self.lead[self.of] if len(self.of) else np.zeros(0, bool)

    @staticmethod
    def _fingerprints(tok: np.ndarray, of: np.ndarray, n_docs: int) -> np.ndarray:
        """64-bit SimHash of each document's shingles, repeats included."""
        out = np.zeros(n_docs, _U)
        names, starts, ends = bounds(of)
        at = 0
        while at < len(names):
            to = at + 1
            while to < len(names) and ends[to] - starts[at] <= 1 << 17:
                to += 1
            low = starts[at]
            ones = np.zeros((to - at, 64), np.int64)
            for x in range(low, ends[to - 1], 1 << 17):  # a long document passes piece by piece
                y = min(ends[to - 1], x + (1 << 17))
                bits = np.unpackbits(tok[x:y].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                if to - at == 1:
                    ones[0] += bits.sum(0, dtype=np.int64)
                else:
                    ones = np.add.reduceat(bits, np.array(starts[at:to]) - low, axis=0, dtype=np.int64)
            count = np.array(ends[at:to]) - np.array(starts[at:to])
            out[names[at:to]] = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel()
            at = to
        return out


def _keys(s: Sets, parts: int, bits: int):
    """Distinct truncated shingles of a chunk's sets in the order of (part, key), where each shingle is among them, and the parts' bounds."""
    u, where = np.unique(s.tok[s.mine] >> _U(64 - bits), return_inverse=True)
    part, key = (u % _U(parts)).astype(np.int64), u // _U(parts)
    order = np.lexsort((key, part))
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return key[order], place[where], bounds(part[order])


def _ask(parts: int, bits: int):
    schema = _schema(_ASK)

    def run(key, t):
        s = Sets(t["raw"].to_pylist())
        keys, where, runs = _keys(s, parts, bits)
        n = np.bincount(where, minlength=len(keys))
        rows = []
        for p, a, b in zip(*runs):
            packed, width = pack_keys(keys[a:b])
            counts, big = pack_counts(n[a:b])
            rows.append({"part": p, "chunk": key[0].as_py(), "keys": packed, "width": width, "counts": counts, "big": big})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


def _add(key, t):
    sets = [unpack_keys(k, w) for k, w in zip(t["keys"].to_pylist(), t["width"].to_pylist())]
    counts = [unpack_counts(c, b) for c, b in zip(t["counts"].to_pylist(), t["big"].to_pylist())]
    u, where = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.minimum(np.bincount(where, weights=np.concatenate(counts), minlength=len(u)), 255).astype(np.uint8)
    ends = np.cumsum([len(s) for s in sets]).tolist()
    rows = [{"part": key[0].as_py(), "chunk": c, "counts": total[where[b - len(s) : b]].tobytes(), "big": b""} for c, s, b in zip(t["chunk"].to_pylist(), sets, ends)]
    return pa.Table.from_pylist(rows, schema=_schema(_SAY))


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: type) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind)))


def _emit(parts: int, bits: int):
    schema = _schema(_OUT)

    def run(key, left, right):
        if not left.num_rows:
            return schema.empty_table()
        s = Sets(left["raw"].to_pylist())
        _, where, runs = _keys(s, parts, bits)
        said = dict(zip(right["part"].to_pylist(), right["counts"].to_pylist()))
        df = np.frombuffer(b"".join(said[p] for p in runs[0]), np.uint8)[where]
        tok, of = s.tok[s.mine], s.of[s.mine]
        order = np.lexsort((tok, df, of))
        tok, of, df = tok[order], of[order], df[order]
        size = np.where(s.lead, s.size, 0)
        at = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        most = s.size + (-s.size * NUM // DEN) + 1
        keep = (at < most[of]) & (df > 1) if len(of) else np.zeros(0, bool)
        n = len(s.size)
        some = np.zeros(n, bool)
        some[of[keep]] = True
        whole = some[s.of] if len(s.of) else np.zeros(0, bool)
        out = [
            left["doc_id"], left["h"], left["times"], pa.array(s.node), pa.array(s.size.astype(np.int32)), pa.array(s.fp.view(np.int64)),
            _lists(tok[keep].view(np.int64), of[keep], n, np.int64), _lists(at[keep], of[keep], n, np.int32), _lists(s.tok[whole].view(np.int64), s.of[whole], n, np.int64),
        ]
        return pa.Table.from_arrays(out, schema=schema)

    return run


def _gathered(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), times, node, size and fp of every row; prefix, at and toks of sets that share shingles, once a chunk."""
    docs = folded(docs.select("doc_id", "text"))
    total = text_bytes(docs)
    parts, tasks = max(12, -(-total // PART_BYTES)), tasks_for(total)
    bits = min(63, max(24, math.ceil(math.log2(max(8, total) / 8)) + 8))
    texts = chunked(docs, max(1, -(-total // CHUNK_BYTES)), more=(F.xxhash64("text").alias("h"),)).repartition(tasks, "chunk")
    asked = texts.groupBy("chunk").applyInArrow(_ask(parts, bits), _ASK)
    said = cut(asked.repartition(max(12, parts // 2), "part").groupBy("part").applyInArrow(_add, _SAY))
    return cut(texts.groupBy("chunk").cogroup(said.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_emit(parts, bits), _OUT))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("toks").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("toks").alias("tb"))
    both = pairs.select("a", "b").distinct().join(a, "a").join(b, "b").filter(_alike("sa", "sb"))
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("share"), (F.col("sa") + F.col("sb")).alias("total"))
    return cut(both.filter(F.col("share") * DEN >= (F.col("total") - F.col("share")) * NUM).select("a", "b"))


def _alike(a: str, b: str):
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _starred(rows: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b) of the first node, by its least doc_id, of each ``by`` and every other one."""
    first = rows.groupBy(by).agg(F.min(F.struct("lead", "node")).alias("f"), F.max(F.struct("lead", "node")).alias("l"))
    first = first.filter("NOT f <=> l").select(by, F.col("f.node").alias("a"))
    return rows.join(first, by).filter("node != a").select("a", F.col("node").alias("b"))


def simhash_proposals(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of the first node of each component of fingerprints within ``bits`` bits and every other one."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    parts = components(links(prints, bits, blocks_for(prints.count(), bits)))
    named = prints.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("part"))
    return _starred(nodes.select("fp", "lead", "node").join(named, "fp"), "part")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), times and grp of every row, rows alike as one."""
    got = _gathered(docs)
    payload = F.when(F.size("prefix") > 0, F.struct("prefix", "at", "toks"))
    nodes = got.groupBy("node", "size").agg(F.min("doc_id").alias("lead"), F.max("fp").alias("fp"), F.first(payload, ignorenulls=True).alias("s"))
    nodes = cut(nodes.filter("s IS NOT NULL").select("node", "size", "lead", "fp", "s.*"))
    keyed = nodes.select("node", "size", "lead", F.explode(F.arrays_zip("prefix", "at")).alias("e")).select(F.col("e.prefix").alias("tok"), F.col("e.at").alias("at"), "node", "size", "lead")
    found = _verified(simhash_proposals(nodes).union(_starred(keyed, "tok")), nodes)
    parts = cut(components(found))
    # What shares a shingle and isn't in one group yet is paired, but for pairs within a shingle's largest group.
    named = keyed.join(parts, "node", "left").select("tok", "at", "node", "size", F.coalesce("component", "node").alias("grp"))
    by = named.groupBy("tok", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("tok").agg(F.max_by("grp", F.struct("n", "grp")).alias("top"), F.count(F.lit(1)).alias("k"))
    rest = cut(named.join(by.filter("k > 1").select("tok", "top"), "tok"))
    a = rest.filter("grp != top").select("tok", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("at").alias("pa"), F.col("grp").alias("ga"))
    b = rest.select("tok", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("at").alias("pb"), F.col("grp").alias("gb"), (F.col("grp") == F.col("top")).alias("other"))
    need = F.expr(f"({NUM} * (sa + sb) + {NUM + DEN - 1}) div {NUM + DEN}")
    behind = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    pairs = a.join(b, "tok").filter((F.col("ga") != F.col("gb")) & (F.col("other") | (F.col("a") < F.col("b"))) & (behind >= need) & _alike("sa", "sb"))
    more = _verified(pairs, nodes)
    if not more.isEmpty():
        parts = cut(components(found.union(more)))
    return got.select("doc_id", "h", "times", "node").join(parts, "node", "left").select("doc_id", "h", "times", F.coalesce("component", "node").alias("grp"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays: the one with the least doc_id."""
    return keep_one(docs, groups(docs))
