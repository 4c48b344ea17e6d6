"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (lower-cased words joined by single spaces) is found
in a text where at most ``k = n * rate`` edits turn it into a substring of the
text treated alike. It is split into k + 1 pieces: at least one stands in the
match unchanged, so exact hits of the pieces, found in one pass by an automaton,
are the only places to look. Pieces stand in groups of ``GROUP``: as there are more
pieces than edits, some group has fewer edits than pieces. Where that is one
edit, the piece beside the hit has a half unchanged, at most one place off. Hits
that pass this are verified on their group, then on the whole item, with Myers'
bit-parallel distance.

Test items are few against the corpus, yet their number isn't taken for
granted: they are matched ``BATCH`` at a time, so the automaton that is sent to
executors is bounded, at the price of one scan of the documents per batch. Documents are never shuffled and
whole texts are read.

Edge cases: null and empty texts match nothing; null items and items without a
word are not searched for; items with fewer than ``SHORTEST`` characters are
matched together with the blanks around them, so that they stand at word
boundaries, by as many edits as their own characters allow; repeated documents
each have their rows, repeated items (same id and text) one; an empty table on
either side gives no rows; a null doc_id or item_id is reported as null; very long texts are searched
whole, in time linear in their length; extra columns pass through ``decontaminate``.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
SHORTEST = 24
GROUP = 2
BATCH = 5000

_WORDS = re.compile(r"\w+").findall


def normal(text: str | None) -> str:
    return " ".join(_WORDS(text.lower())) if text else ""


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def least_distance(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of a pattern of ``m`` characters to any substring of ``text`` (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, get = full, 0, m, m, peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


#: Matchers that this worker has built, the last ones, by the token of their items.
_BUILT: dict[tuple[str, float], Matcher] = {}


def _matcher(shared, rate: float) -> Matcher:
    """The matcher of broadcast items (token, items), built once per worker."""
    token, items = shared.value
    if (token, rate) not in _BUILT:
        while len(_BUILT) >= 4:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[token, rate] = Matcher(items, rate)
    return _BUILT[token, rate]


class Matcher:
    """Finds items, given as (id, text) pairs, in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        pieces: dict[str, list[tuple[int, int, int, tuple]]] = defaultdict(list)
        for item_id, text in sorted({(i, normal(t)) for i, t in items if t}, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            n = len(text)
            if not n:
                continue
            k, short = int(n * rate), n < SHORTEST
            if short:
                text = f" {text} "
            m = len(text)
            edge = [m * j // (k + 1) for j in range(k + 2)]
            groups = -(-(k + 1) // GROUP)
            cuts = [(k + 1) * g // groups for g in range(groups + 1)]
            spans = [(edge[i], edge[j], j - i - 1, masks(text[edge[i] : edge[j]])) for i, j in zip(cuts, cuts[1:])]
            for j, (a, b) in enumerate(zip(edge, edge[1:])):
                of = next(g for g in range(groups) if cuts[g + 1] > j)
                halves = ()
                if cuts[of + 1] - cuts[of] == 2:
                    i = cuts[of] + cuts[of + 1] - 1 - j
                    x, y = edge[i], edge[i + 1]
                    z = (x + y) // 2
                    halves = (text[x:z], x - a - 1, z - a + 1, text[z:y], z - a - 1, y - a + 1)
                pieces[text[a:b]].append((len(self.items), a, of, halves))
            self.items.append((item_id, n, k, masks(text), spans, m, short))
        self.find = None
        if pieces:
            self.find = ahocorasick.Automaton()
            for piece, places in pieces.items():
                self.find.add_word(piece, (len(piece), tuple(places)))
            self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, least distance, characters of the item) of every item found in a text."""
        text = normal(text)
        if not text or self.find is None:
            return []
        # Only short items see the blanks around the text: others may not spend them.
        padded = f" {text} "
        spots: dict[int, set[int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for end, (size, places) in self.find.iter(padded):
            for item, offset, of, halves in places:
                short = self.items[item][6]
                within, here = (padded, end + 1 - size) if short else (text, end - size)
                if halves:
                    one, a, b, two, c, d = halves
                    if within.find(one, max(0, here + a), max(0, here + b)) < 0 and within.find(two, max(0, here + c), max(0, here + d)) < 0:
                        continue
                start = here - offset  # where the item would start without edits
                at = (item, of, start)
                if at in seen:
                    continue
                a, b, most, peq = self.items[item][4][of]
                # The hit fixes the shift inside its group to within the group's own edits.
                if least_distance(peq, b - a, within[max(0, start + a - most) : max(0, start + b + most)]) <= most:
                    spots.setdefault(item, set()).add(start)
                else:
                    seen.add(at)
        found = []
        for item, starts in spots.items():
            item_id, n, k, peq, _, m, short = self.items[item]
            within = padded if short else text
            best, reach = k + 1, -1
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), s + m + k
                if a <= reach:
                    windows[-1][1] = reach = b
                else:
                    windows.append([a, b])
                    reach = b
            for a, b in windows:
                best = min(best, least_distance(peq, m, within[a:b]))
            if best <= k:
                found.append((item_id, best, n))
        return found


def _batches(items: DataFrame, batch: int) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ``batch`` at a time."""
    some = items.select("item_id", "text").filter("text IS NOT NULL")
    count = -(-some.count() // batch)
    for k in range(count):
        yield [tuple(r) for r in some.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE, batch: int = BATCH) -> DataFrame:
    """doc_id, item_id, distance and item_chars of every item found in a document's text."""
    schema = "doc_id long, item_id long, distance long, item_chars long"
    out = docs.sparkSession.createDataFrame([], schema)
    for some in _batches(items, batch):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, some))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared, rate)
            for b in batches:
                rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for f in m.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "distance", "item_chars"]
                )

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, batch: int = BATCH) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    for some in _batches(items, batch):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, some))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared, rate)
            for b in batches:
                yield b.filter(pa.array([not m.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
