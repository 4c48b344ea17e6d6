"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Words are runs of anything but ASCII blanks, A-Z lower-cased; shingles are four
words joined by one space, repeats included (fewer words: the whole sequence;
none: fingerprint zero). A fingerprint bit is set if it is set in over half of
the shingles' 64-bit hashes.

Documents with one fingerprint are one node from the start, so a group of exact
copies of any size is a single row before anything is joined. Two fingerprints
within ``bits`` differing bits agree on at least ``BLOCKS - bits`` of ``BLOCKS``
blocks; nodes are joined on every such choice of blocks and each pair is
verified. ``blocks_for`` raises the number of blocks with the number of nodes, so
that buckets stay small at any size. A choice's bucket that holds over
``HOT`` nodes isn't paired: its nodes get all fingerprints within the larger half
of the distance as keys; a key is a way between two nodes if it is within the
smaller half of one of them, so all nodes at a key are linked to the least of those,
which is exact and linear in the bucket.

Edge cases: null text and text without words have fingerprint zero and link like
any other; rows without a doc_id link like any other, and their component_id is
null where no row of the component has a doc_id (which must be below ``NAMELESS``);
repeated rows keep their rows; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import cut
from lumenlog.llm.graph import components

SHINGLE = 4
SEED = 42
BITS = 4
BLOCKS = 6
#: Nodes that a bucket may hold on average: more nodes are split into more blocks.
CROWD = 4
HOT = 4000
#: Fingerprints of which no row has a doc_id are nodes from here on.
NAMELESS = 1 << 62

_FIND = regex.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingle hashes unpacked to bits at a time: bounds memory for very long texts.
_SLAB = 1 << 15


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    if not text:
        return 0
    raw = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).translate(_LOWER)
    ws = _FIND(raw)
    if not ws:
        return 0
    line, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLAB):
        slab = hashes[k : k + _SLAB]
        ones += np.unpackbits(slab.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """The masks of all choices of ``blocks - bits`` blocks out of ``blocks``, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(nodes: int, bits: int = BITS) -> int:
    """Blocks that leave a few nodes in a bucket on average; any number gives the same links."""
    blocks = BLOCKS
    while nodes > CROWD << (64 * (blocks - bits) // blocks):
        blocks += 1
    return blocks


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)])).alias("c")
    return nodes.select("fp", "node", choice).select("fp", "node", "c.k", "c.part")


def _near(nodes: DataFrame, radius: int, inner: int) -> DataFrame:
    """(key, node, close) for every key within ``radius`` bits of each node's fingerprint; close: within ``inner``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [np.uint64(0)]
        for r in range(1, radius + 1):
            flips += [np.uint64(sum(1 << b for b in c)) for c in combinations(range(64), r)]
        flips = np.array(flips, dtype=np.uint64)
        close = np.bitwise_count(flips) <= inner
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            ids = batch.column(1).to_numpy()
            for k in range(0, len(fps), 32):
                keys = (fps[k : k + 32, None] ^ flips).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids[k : k + 32], len(flips))), pa.array(np.tile(close, len(fps[k : k + 32])))], names=["key", "node", "close"])

    return nodes.select("fp", "node").mapInArrow(run, "key long, node long, close boolean")


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, hot: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes (fp, node) within ``bits`` bits of each other."""
    masks = block_masks(blocks, bits)
    keyed = _keyed(nodes, masks)
    hot = HOT if hot is None else hot
    busy = keyed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sizes = cut(busy)
    usual, large = sizes.filter(F.col("n") <= hot).select("k", "part"), sizes.filter(F.col("n") > hot).select("k", "part")
    side = cut(keyed.join(usual, ["k", "part"], "left_semi"))
    a = side.select("k", "part", F.col("fp").alias("fa"), F.col("node").alias("a"))
    b = side.select("k", "part", F.col("fp").alias("fb"), F.col("node").alias("b"))
    apart = F.col("fa").bitwiseXOR(F.col("fb"))
    pairs = a.join(b, ["k", "part"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= bits))
    found = pairs.select("a", "b")
    if large.isEmpty():
        return found
    members = keyed.join(large, ["k", "part"], "left_semi").select("fp", "node").distinct()
    near = _near(members, bits - bits // 2, bits // 2)
    least = near.groupBy("key").agg(F.min(F.when(F.col("close"), F.col("node"))).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND a IS NOT NULL").select("key", "a")
    return found.union(near.join(least, "key").filter("node != a").select("a", F.col("node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = cut(fingerprints(docs))
    nameless = F.lit(NAMELESS) + F.pmod(F.col("fp"), F.lit(NAMELESS))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", nameless).alias("node")))
    parts = components(links(nodes, bits, blocks_for(nodes.count(), bits)))
    of = F.coalesce("component", "node")
    named = nodes.join(parts, "node", "left").select("fp", F.when(of < NAMELESS, of).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Exactly one row of each group stays: the one with the least doc_id, null the last.

    rows: doc_id, h (xxhash64 of the text) and grp of every row of ``docs``, or of rows alike with
    their number ``times``. Rows alike in doc_id and text are repeats, any one of which may stay.
    """
    count = F.sum("times") if "times" in rows.columns else F.count(F.lit(1))
    rows = cut(rows)
    best = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    marked = rows.groupBy("grp", "doc_id", "h").agg((count > 1).alias("again")).join(best, "grp")
    some = cut(marked.select("doc_id", "h", stays.alias("stays"), "again").filter("again OR NOT stays"))
    keyed = docs.withColumn("_h", F.xxhash64("text"))

    def pick(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("h").alias("_k"))
        return left.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), how)

    kept = pick(keyed, some, "left_anti")
    again = some.filter("stays")
    if not again.isEmpty():
        kept = kept.union(pick(keyed, again, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return kept.select(*docs.columns)


def dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each group stays: the one with the least doc_id, null the last (of its repeats, any one row)."""
    key = F.shiftrightunsigned(F.xxhash64("text"), 2)
    texts = docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = near_duplicates(texts, bits).select(F.col("doc_id").alias("k"), F.col("component_id").alias("grp"))
    return keep_one(docs, docs.select("doc_id", F.xxhash64("text").alias("h"), key.alias("k")).join(found, "k").drop("k"))
