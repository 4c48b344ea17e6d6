"""Exact substring dedup with suffix arrays built by induced sorting.

A byte is removed if it lies in a 100-byte string that also starts earlier
(smaller doc_id, or the same document further left) in the input.

1. Every 100-byte window has an anchor: the least hash of its 40-byte grams.
   Equal windows have equal anchors. Chunks of documents send their distinct
   anchors to the parts of the key space, which answer which ones occur in more
   than one run of windows; text under other anchors can't repeat. Grams are of
   several words, as shorter ones, of two or three, are met by chance the more
   often the larger the input is, and send text to shards that holds no repeat.
2. Chunks cut out the runs of windows under repeated anchors and send each
   distinct run once, with its first place, to the shard of its anchor. Anchors
   with up to ``FEW`` runs go to a shard chosen by the set of chunks that hold
   them, as neighbouring anchors of a copied passage do, and neighbouring runs
   for one shard travel as one; others go by their own hash, run by run, as most
   of their runs are alike. An anchor with over ``HOT`` runs is sent window by
   window, each under a hash of its own content, so that a passage in a third of
   all documents is dealt over all shards.
3. A shard joins its distinct runs, in the order of their first places, to one
   text, builds its suffix array by induced sorting and the permuted common
   prefixes, and groups the windows with 100 common bytes. All but the least of
   a group start later than another; a run's repeats do as well.
4. Chunks mark the bytes of these windows and return one row per document.

Copies of a whole text are found by a 128-bit hash in step 1; only the first is
cut into runs, the others are removed whole (if they have 100 bytes).

Edge cases: null and empty texts return zeros and the hash of nothing; texts
under 100 bytes lose nothing; of rows with the same doc_id and text one counts as
first; rows with a null doc_id come before all others; a very long text is one chunk's
work, as its bytes and their hashes, several times its size in memory; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.llm.common import cut, folded, text_bytes, unfolded
from lumenlog.llm.exchange import chunked, counts_for, part_of, split, tasks_for
from lumenlog.llm.hashing import mix64, sliding_min, window_hashes
from lumenlog.llm.induced import permuted_prefixes, suffix_array

LENGTH = 100
#: Bytes of an anchor: two fifths of a window leave an anchor every 32 bytes.
GRAM = 40
#: Runs of anchors with at most this many are joined with their neighbours.
FEW = 8
#: An anchor with more runs than this is dealt window by window.
HOT = 5000
CHUNK_BYTES = 2 << 20
#: Shards hold about one such share of the text's bytes.
SHARD_BYTES = 4 << 20

_ASK = "part long, chunk long, anchors binary, runs binary, texts binary, owners binary"
_KNOWN = "chunk long, anchors binary, shards binary, kinds binary, texts binary, owners binary"
_RUNS = "shard long, chunk long, sizes binary, doc binary, at binary, again binary, body binary"
_LATER = "chunk long, hash binary, sizes binary, first binary, later binary"
_NULL_ID = np.iinfo(np.int64).min


class Chunk:
    """The documents of one chunk in the order of doc_id, joined to one array."""

    def __init__(self, ids: pa.ChunkedArray, raw: pa.ChunkedArray):
        raws = raw.to_pylist()
        keys = [_NULL_ID if i is None else i for i in ids.to_pylist()]
        order = sorted(range(len(raws)), key=lambda k: (keys[k], raws[k]))
        self.order = order
        self.raws = [raws[k] for k in order]
        self.ids = np.array([keys[k] for k in order], np.int64)
        self.size = np.array([len(r) for r in self.raws], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.text = np.frombuffer(b"".join(self.raws), np.uint8)

    def hashes(self) -> np.ndarray:
        """128-bit hashes of the texts as pairs of words."""
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in self.raws), np.uint64).reshape(-1, 2)

    def runs(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, windows, document, anchor's places) of each maximal run of windows with one anchor.

        Places are 1, or 2 if the anchor's gram stands in the run more than once,
        so that windows inside the run may be equal.
        """
        grams = window_hashes(self.text, gram)
        least = sliding_min(grams, length - gram + 1)
        n = len(least)
        if n == 0:
            z = np.zeros(0, np.int64)
            return least, z, z, z, z
        # Windows that cross documents end a run and belong to none.
        across = np.minimum(self.size, length - 1)
        inside = np.repeat(np.tile([True, False], len(self.size)), np.column_stack([self.size - across, across]).ravel())[:n]
        new = np.ones(n, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= inside[1:] != inside[:-1]
        # Neighbouring documents are always parted by crossing windows, as length > 1.
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        places = np.ones(len(at), np.int64)
        # A window starts with its anchor and the next one, without it, has the same anchor.
        twice = np.flatnonzero((grams[: n - 1] == least[:-1]) & ~new[1:])
        places[np.searchsorted(at, twice, side="right") - 1] = 2
        del grams
        good = inside[at]
        at, size, places = at[good], size[good], places[good]
        return least[at], at, size, np.searchsorted(self.end, at, side="right"), places


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _ask(parts: int, length: int, gram: int):
    def run(key, t):
        c = Chunk(t["doc_id"], t["raw"])
        rows = []
        anchor, _, _, _, places = c.runs(length, gram)
        anchors, where = np.unique(anchor, return_inverse=True)
        counts = np.bincount(where, weights=places, minlength=len(anchors))
        blank = {"anchors": b"", "runs": b"", "texts": b"", "owners": b""}
        for p, (a, n) in split(part_of(anchors, parts), parts, anchors, counts.astype(np.uint32)):
            rows.append(blank | {"part": p, "anchors": _pack(a), "runs": _pack(n)})
        # The documents are in order: the first of each hash has the least doc_id.
        h, first = np.unique(c.hashes(), axis=0, return_index=True)
        for p, (x, i) in split(part_of(h[:, 0], parts), parts, h, c.ids[first]):
            rows.append(blank | {"part": p, "texts": _pack(x), "owners": _pack(i)})
        return pa.Table.from_pylist([r | {"chunk": key[0].as_py()} for r in rows], schema=_schema(_ASK))

    return run


def _know(shards: int, hot: int):
    def run(key, t):
        chunk = t["chunk"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in t["anchors"].to_pylist()]
        anchors = np.concatenate(sets)
        runs = np.frombuffer(b"".join(t["runs"].to_pylist()), np.uint32).astype(np.int64)
        of = np.repeat(chunk, [len(s) for s in sets])
        order = np.argsort(anchors, kind="stable")
        anchors, runs, of = anchors[order], runs[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, np.int64)
        holders = np.diff(np.append(new, len(anchors)))
        total, key = runs, anchors
        if len(anchors):
            total = np.repeat(np.add.reduceat(runs, new), holders)
            # The set of holding chunks as a sum, which neighbouring anchors share.
            key = np.repeat(mix64(np.add.reduceat(mix64(of.astype(np.uint64) + np.uint64(1)), new)), holders)
        kind = np.where(total > hot, 2, np.where(total > FEW, 1, 0)).astype(np.uint8)
        shard = part_of(np.where(kind == 0, key, anchors), shards).astype(np.int32)
        more = total > 1
        texts = np.frombuffer(b"".join(t["texts"].to_pylist()), np.uint64).reshape(-1, 2)
        owners = np.frombuffer(b"".join(t["owners"].to_pylist()), np.int64)
        holder = np.repeat(chunk, [len(b) // 16 for b in t["texts"].to_pylist()])
        order = np.lexsort((holder, owners, texts[:, 1], texts[:, 0]))
        texts, owners, holder = texts[order], owners[order], holder[order]
        new = np.concatenate([[True], (texts[1:] != texts[:-1]).any(axis=1)]) if len(texts) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        # A chunk learns of a text that another one owns.
        copy = ~new
        out = []
        blank = {"anchors": b"", "shards": b"", "kinds": b"", "texts": b"", "owners": b""}
        names, at = np.unique(of[more], return_inverse=True)
        for k, (a, b, c) in split(at, len(names) or 1, anchors[more], shard[more], kind[more]):
            out.append(blank | {"chunk": int(names[k]), "anchors": _pack(a), "shards": _pack(b), "kinds": _pack(c)})
        names, at = np.unique(holder[copy], return_inverse=True)
        for k, (x, i) in split(at, len(names) or 1, texts[copy], owners[lead[copy]]):
            out.append(blank | {"chunk": int(names[k]), "texts": _pack(x), "owners": _pack(i)})
        return pa.Table.from_pylist(out, schema=_schema(_KNOWN))

    return run


class Cuts:
    """The runs of a chunk that may repeat: positions, windows, shards and hashes, in order."""

    def __init__(self, c: Chunk, known: pa.Table, shards: int, length: int, gram: int):
        anchors = np.frombuffer(b"".join(known["anchors"].to_pylist()), np.uint64)
        goal = np.frombuffer(b"".join(known["shards"].to_pylist()), np.int32)
        kinds = np.frombuffer(b"".join(known["kinds"].to_pylist()), np.uint8)
        order = np.argsort(anchors)
        anchors, goal, kinds = anchors[order], goal[order], kinds[order]
        self.copy = copies(c, known)
        anchor, at, size, doc, _ = c.runs(length, gram)
        place = np.minimum(np.searchsorted(anchors, anchor), max(0, len(anchors) - 1))
        keep = (anchors[place] == anchor) & ~self.copy[doc] if len(anchors) else np.zeros(len(anchor), bool)
        at, size, place = at[keep], size[keep], place[keep]
        kind, shard = kinds[place], goal[place].astype(np.int64)
        # Neighbouring runs for one shard become one.
        tied = np.zeros(len(at), bool)
        tied[1:] = (kind[1:] == 0) & (kind[:-1] == 0) & (shard[1:] == shard[:-1]) & (at[:-1] + size[:-1] == at[1:])
        head = np.flatnonzero(~tied)
        if len(head) < len(at):
            size = np.add.reduceat(size, head)
            at, kind, shard = at[head], kind[head], shard[head]
        if (kind == 2).any():
            # Windows of hot anchors one by one.
            many = np.where(kind == 2, size, 1)
            single = np.repeat(kind == 2, many)
            at = np.repeat(at, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            size, shard = np.where(single, 1, np.repeat(size, many)), np.repeat(shard, many)
            shard[single] = part_of(_window_keys(c, at[single], length), shards)
        self.at, self.size, self.shard = at, size, shard
        text = memoryview(c.text)
        self.hash = [xxhash.xxh3_128_digest(text[a : a + s + length - 1]) for a, s in zip(at.tolist(), size.tolist())]


def _window_keys(c: Chunk, at: np.ndarray, length: int) -> np.ndarray:
    text = memoryview(c.text)
    return np.array([xxhash.xxh3_64_intdigest(text[a : a + length]) for a in at.tolist()], np.uint64)


def copies(c: Chunk, known: pa.Table) -> np.ndarray:
    """Which documents are whole copies of one that comes earlier."""
    words = b"".join(known["texts"].to_pylist())
    owners = np.frombuffer(b"".join(known["owners"].to_pylist()), np.int64).tolist()
    owner = {words[16 * k : 16 * k + 16]: o for k, o in enumerate(owners)}
    out, seen = np.zeros(len(c.raws), bool), set()
    for k, r in enumerate(c.raws):
        h = xxhash.xxh3_128_digest(r)
        out[k] = h in seen or h in owner
        seen.add(h)
    return out


def _cut(shards: int, length: int, gram: int):
    def run(key, left, right):
        rows = []
        if left.num_rows:
            c = Chunk(left["doc_id"], left["raw"])
            cuts = Cuts(c, right, shards, length, gram)
            first: dict[bytes, int] = {}
            again = np.zeros(len(cuts.hash), np.uint32)
            for k, h in enumerate(cuts.hash):
                again[first.setdefault(h, k)] += 1
            one = np.fromiter(first.values(), np.int64, len(first))
            at, size = cuts.at[one], cuts.size[one] + length - 1
            doc = np.searchsorted(c.end, at, side="right")
            for s, (a, n, d, g) in split(cuts.shard[one], shards, at, size, doc, again[one]):
                body = b"".join(c.text[x : x + y].tobytes() for x, y in zip(a.tolist(), n.tolist()))
                rows.append({"shard": s, "chunk": key[0].as_py(), "sizes": _pack(n), "doc": _pack(c.ids[d]), "at": _pack(a - c.start[d]), "again": _pack(g), "body": body})
        return pa.Table.from_pylist(rows, schema=_schema(_RUNS))

    return run


def later_windows(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions of ``text`` whose window, inside its run, equals a window further left."""
    n = len(text)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + np.maximum(sizes - length + 1, 0), -1)
    valid = np.cumsum(valid[:n]) > 0
    order = suffix_array(text)
    apart = permuted_prefixes(text, order)[order] < length
    apart[:1] = True
    group = np.flatnonzero(apart)
    least = np.minimum.reduceat(np.where(valid[order], order, n), group) if n else order
    later = np.zeros(n, bool)
    later[order] = order > np.repeat(least, np.diff(np.append(group, n)))
    return later & valid


def _shard(length: int):
    def run(key, t):
        chunk = np.repeat(t["chunk"].to_numpy(), [len(b) // 8 for b in t["sizes"].to_pylist()])
        sizes = np.frombuffer(b"".join(t["sizes"].to_pylist()), np.int64)
        doc = np.frombuffer(b"".join(t["doc"].to_pylist()), np.int64)
        at = np.frombuffer(b"".join(t["at"].to_pylist()), np.int64)
        again = np.frombuffer(b"".join(t["again"].to_pylist()), np.uint32)
        body = memoryview(b"".join(t["body"].to_pylist()))
        ends = np.cumsum(sizes)
        order = np.lexsort((at, doc))
        # Distinct runs in the order of their first places.
        names: dict[bytes, int] = {}
        of = np.empty(len(order), np.int64)
        lead: list[int] = []
        hashes: list[bytes] = []
        for k in order.tolist():
            h = xxhash.xxh3_128_digest(body[ends[k] - sizes[k] : ends[k]])
            of[k] = names.setdefault(h, len(lead))
            if of[k] == len(lead):
                lead.append(k)
                hashes.append(h)
        text = np.frombuffer(b"".join(body[ends[k] - sizes[k] : ends[k]] for k in lead), np.uint8)
        size = sizes[lead]
        start = np.cumsum(size) - size
        later = later_windows(text, start, size, length)
        total = np.bincount(of, minlength=len(lead))
        some = np.add.reduceat(later, start) > 0 if len(lead) else np.zeros(0, bool)
        lead_of = np.array(lead, np.int64)
        is_first = lead_of[of] == np.arange(len(of))
        # A chunk hears of a run if any of its places starts later than an equal window.
        tell = np.flatnonzero(some[of] | ~is_first | (again > 1))
        del total
        rows = []
        names_, where = np.unique(chunk[tell], return_inverse=True)
        for k, (x,) in split(where, len(names_) or 1, tell):
            j = of[x]
            rows.append({
                "chunk": int(names_[k]), "hash": b"".join(hashes[i] for i in j.tolist()), "sizes": _pack(size[j] - length + 1), "first": _pack(is_first[x]),
                "later": b"".join(later[start[i] : start[i] + size[i] - length + 1].tobytes() if f else b"" for i, f in zip(j.tolist(), is_first[x].tolist())),
            })
        return pa.Table.from_pylist(rows, schema=_schema(_LATER))

    return run


def _removed(c: Chunk, cuts: Cuts, told: pa.Table, length: int) -> np.ndarray:
    """Marks the bytes of the chunk that go."""
    edge = np.zeros(len(c.text) + 1, np.int32)
    # For each run that was told of: its first place here (or None where all places go) and its later windows.
    news: dict[bytes, np.ndarray | None] = {}
    for h, sizes, first, later in zip(told["hash"].to_pylist(), told["sizes"].to_pylist(), told["first"].to_pylist(), told["later"].to_pylist()):
        sizes, first, at = np.frombuffer(sizes, np.int64), np.frombuffer(first, bool), 0
        later = np.frombuffer(later, bool)
        for k, (s, f) in enumerate(zip(sizes.tolist(), first.tolist())):
            news[h[16 * k : 16 * k + 16]] = later[at : at + s] if f else None
            at += s if f else 0
    seen = set()
    for h, a, s in zip(cuts.hash, cuts.at.tolist(), cuts.size.tolist()):
        if h not in news:
            continue
        mask = news[h]
        if mask is None or h in seen:
            edge[a] += 1
            edge[a + s - 1 + length] -= 1
        else:
            seen.add(h)
            flips = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
            for x, y in zip(flips[::2].tolist(), flips[1::2].tolist()):
                edge[a + x] += 1
                edge[a + y - 1 + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    for k in np.flatnonzero(cuts.copy & (c.size >= length)).tolist():
        gone[c.start[k] : c.end[k]] = True
    return gone


def _result(shards: int, length: int, gram: int, rest: bool):
    def run(key, left, right):
        schema = _schema(_OUT)
        if rest:
            schema = schema.append(pa.field("kept", pa.string())).append(left.schema.field("rest"))
        if not left.num_rows:
            return schema.empty_table()
        c = Chunk(left["doc_id"], left["raw"])
        cuts = Cuts(c, right.filter(pc.invert(right["kind"])), shards, length, gram)
        gone = _removed(c, cuts, right.filter(right["kind"]), length)
        marks = [gone[a:b] for a, b in zip(c.start.tolist(), c.end.tolist())]
        kept = [c.text[a:b][~g].tobytes() for a, b, g in zip(c.start.tolist(), c.end.tolist(), marks)]
        spans = [int(np.count_nonzero(g[1:] & ~g[:-1]) + (g[0] if len(g) else 0)) for g in marks]
        order = pa.array(c.order, pa.int64())
        out = [left["doc_id"].take(order), pa.array(c.size), pa.array([int(g.sum()) for g in marks], pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        if rest:
            # A cut inside a character drops what is left of that character.
            out += [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), left["rest"].take(order)]
        return pa.Table.from_arrays(out, schema=schema)

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, rest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    ``rest``: the kept text and a struct of the other columns of ``docs`` follow; then rows alike in
    doc_id and text are one row.
    """
    gram = min(gram, length)
    docs = folded(docs if rest else docs.select("doc_id", "text"))
    total = text_bytes(docs)
    chunks, parts = counts_for(total, CHUNK_BYTES)
    shards, tasks = max(12, -(-total // SHARD_BYTES)), tasks_for(total)
    texts = chunked(docs, chunks, rest).repartition(tasks, "chunk")
    asked = texts.groupBy("chunk").applyInArrow(_ask(parts, length, gram), _ASK)
    known = cut(asked.repartition(max(12, parts // 2), "part").groupBy("part").applyInArrow(_know(shards, hot), _KNOWN))
    runs = texts.groupBy("chunk").cogroup(known.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_cut(shards, length, gram), _RUNS)
    later = cut(runs.repartition(max(12, shards // 2), "shard").groupBy("shard").applyInArrow(_shard(length), _LATER))
    none = F.lit(None).cast("binary")
    news = known.select("chunk", F.lit(False).alias("kind"), "anchors", "shards", "kinds", "texts", "owners", *[none.alias(n) for n in ("hash", "sizes", "first", "later")])
    news = news.union(later.select("chunk", F.lit(True), *[none] * 5, "hash", "sizes", "first", "later"))
    out = T.StructType.fromDDL(_OUT)
    if rest:
        out = out.add("kept", "string").add("rest", texts.schema["rest"].dataType)
    once = texts.groupBy("chunk").cogroup(news.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_result(shards, length, gram, rest), out)
    again = docs.filter("times > 1")
    if rest or again.isEmpty():
        return once
    # A repeat of a row starts later in all its strings.
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    gone = size >= length
    left = F.sha2(F.when(gone, F.lit("")).otherwise(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    more = again.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), left.alias("kept_sha256"), (F.col("times") - 1).alias("times"))
    return once.union(unfolded(more))


def rewrite(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes; all columns stay, ``n_chars`` follows the text.

    Documents of which nothing is left go, repeats of a row too; those that had no text stay. A cut
    inside a character drops what is left of that character. Texts under ``length`` bytes stay as they are.
    """
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < length
    found = suffix_dedup(docs.filter(~short), length, rest=True).filter("n_removed < n_bytes OR n_bytes = 0")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.char_length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"rest.`{c}`").alias(c))
    return found.select(*columns).union(docs.filter(short))

