"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled examples, at most ``EXAMPLES`` of them drawn by a hash of doc_id (a
documented bound), become vectors over all their lower-cased words, of either label
and any frequency. A word weighs ``(1 + log tf) * idf * (1 + g)``: ``g`` is the
likelihood-ratio statistic of the word and label 1 over the examples, zero where the
word isn't more frequent under label 1, so that words that tell draw texts together
more than topics do. The ``NEAREST`` examples of a text are found exactly with a
block-max inverted index: examples stand in blocks of ``BLOCK``, each word knows its
greatest weight in each block, and blocks are visited from the highest bound down
until no bound can reach the nearest ones.

Votes are weighted by distance. A monotone curve turns them into scores; it is fitted on
votes that each of ``SPLITS`` parts of the examples gets from a model of the other
parts, whose words, weights and neighbours know nothing of the part. Texts
without any word of the examples get the rate of label 1.

Scoring reads each text once, whole, without a shuffle; the model is bounded by
the number of examples and their distinct words. Examples come to the driver one by one and stay as
counts of their words.

Edge cases: null and empty texts score as texts without words; equal distances
go to the example with the smaller doc_id; repeated label rows count once per
(doc_id, label); of several texts of one doc_id the least is taken; labels that are
null are left out; a null doc_id has no label; without examples or with one label only, all scores
are the rate of label 1 (0 if there are none); extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2
EXAMPLES = 6000
NEAREST = 15
BLOCK = 128
SPLITS = 5
#: A word in over one of so many examples is common; texts that are compared with common words together.
COMMON = 16
TOGETHER = 64
CUTOFF = 0.3
#: Scores of texts that a worker remembers, for copies.
MEMO = 20_000

_WORDS = re.compile(r"[^\W_]+").findall

Example = tuple[int | None, Counter, int]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def words(text: str | None) -> Counter:
    return Counter(_WORDS(text.lower())) if text else Counter()


def telling(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic of words in k1 of n1 and k0 of n0 examples; 0 where they don't speak for the first kind."""
    if not n1 or not n0:
        return np.zeros(len(k1))

    def side(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / n / p), 0.0) + np.where(n > k, (n - k) * np.log((n - k) / n / (1 - p)), 0.0)

    p = (k1 + k0) / (n1 + n0)
    return np.where(k1 * n0 > k0 * n1, 2 * (side(k1, n1, p) + side(k0, n0, p)), 0.0)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Coded:
    """Examples with words as numbers, in the order of doc_id; the numbers hold for all parts of them."""

    def __init__(self, examples: Iterable[Example]):
        self.place: dict[str, int] = {}
        rows = []
        for i, counts, y in examples:
            ids = np.array([self.place.setdefault(w, len(self.place)) for w in counts], np.int32)
            rows.append((i, ids, np.array(list(counts.values()), np.int32), y))
        rows.sort(key=lambda e: (e[0] is None, e[0] or 0, e[3]))
        self.rows = rows


class Index:
    """Block-max inverted index over examples: finds the exact nearest ones and their vote.

    Words in over one of ``COMMON`` examples have all their weights side by side, so that what they add to a
    block's bound is known exactly; the others' greatest weights in a block bound the rest.
    """

    def __init__(self, place: dict[str, int], rows: list[tuple]):
        self.place, n, kinds = place, len(rows), len(place)
        self.y = np.array([y for _, _, _, y in rows], float)
        n1 = int(self.y.sum())
        self.rate = n1 / n if n else 0.0
        sizes = np.array([len(ids) for _, ids, _, _ in rows], np.int64)
        word = np.concatenate([np.zeros(0, np.int32), *[ids for _, ids, _, _ in rows]]).astype(np.int64)
        tf = np.concatenate([np.zeros(0, np.int32), *[k for _, _, k, _ in rows]]).astype(float)
        of = np.repeat(np.arange(n), sizes)
        df = np.bincount(word, minlength=kinds)
        k1 = np.bincount(word, weights=self.y[of], minlength=kinds)
        self.seen = df > 0
        self.told = telling(k1, n1, df - k1, n - n1)
        self.scale = (np.log((1 + n) / (1 + df)) + 1) * (1 + self.told)
        weight = (1 + np.log(tf)) * self.scale[word]
        norm = np.sqrt(np.bincount(of, weights=weight * weight, minlength=n))
        weight /= np.where(norm > 0, norm, 1)[of]
        # Examples with the same strongest word share blocks, so that bounds are tight; ``row`` is an example's seat.
        lead = np.full(n, -1)
        by = np.lexsort((weight, of))
        ends = np.cumsum(sizes)
        lead[sizes > 0] = word[by][ends[sizes > 0] - 1]
        self.seat = np.lexsort((np.arange(n), lead, self.y))
        row = np.empty(n, np.int64)
        row[self.seat] = np.arange(n)
        self.blocks = n // BLOCK + 1
        often = np.flatnonzero(df > max(2, n / COMMON))
        self.common = np.full(kinds, -1)
        self.common[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        on = self.common[word] >= 0
        self.dense[self.common[word[on]], row[of[on]]] = weight[on]
        word, of, weight = word[~on], of[~on], weight[~on]
        order = np.lexsort((row[of], word))
        self.row, self.weight, word = row[of][order], weight[order], word[order]
        # An entry is a word in a block: its postings and the greatest of their weights.
        first = np.flatnonzero(np.diff(word * self.blocks + self.row // BLOCK, prepend=-1))
        self.block = self.row[first] // BLOCK
        self.begin, self.count = first, np.diff(np.append(first, len(word)))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(word[first], np.arange(kinds + 1))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The known words of a text and their weights."""
        get = self.place.get
        t = np.array([get(w, -1) for w in counts], np.int64)
        return self.coded(t, np.array(list(counts.values()), float))

    def coded(self, t: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.flatnonzero(t >= 0)
        known = known[self.seen[t[known]]]
        t = t[known]
        w = (1 + np.log(tf[known])) * self.scale[t]
        order = np.argsort(t)
        return t[order], w[order] / (np.sqrt((w * w).sum()) or 1.0)

    def shared(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common words add to the similarity of each vector and each example, by seats."""
        q = np.zeros((len(vectors), len(self.dense)))
        for k, (t, w) in enumerate(vectors):
            c = self.common[t]
            q[k, c[c >= 0]] = w[c >= 0]
        return q @ self.dense

    def nearest(self, t: np.ndarray, w: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, places of examples) of the exact nearest ones, nearest first; ``base`` is the vector's row of ``shared``."""
        if base is None:
            base = self.shared([(t, w)])[0]
        rare = self.common[t] < 0
        t, w = t[rare], w[rare]
        sizes = self.entry[t + 1] - self.entry[t]
        e = _spread(self.entry[t], sizes)
        q = np.repeat(w, sizes)
        block = self.block[e]
        by_block = base.reshape(-1, BLOCK)
        bound = by_block.max(axis=1) + np.bincount(block, weights=q * self.most[e], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        scores, rows, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 8
        while at < len(order):
            if len(scores) >= NEAREST:
                order = order[: at + int(np.count_nonzero(bound[order[at:]] >= scores[NEAREST - 1] - 1e-9))]
                if at >= len(order):
                    break
            visit = np.sort(order[at : at + step])
            low = np.full(self.blocks, -1)
            low[visit] = np.arange(len(visit))
            on = np.flatnonzero(low[block] >= 0)
            n = self.count[e[on]]
            p = _spread(self.begin[e[on]], n)
            seats = self.row[p]
            s = by_block[visit].ravel() + np.bincount(low[seats // BLOCK] * BLOCK + seats % BLOCK, weights=np.repeat(q[on], n) * self.weight[p], minlength=len(visit) * BLOCK)
            # Only those that can be among the nearest are rounded and put in order.
            least = np.partition(s, len(s) - NEAREST)[len(s) - NEAREST] - 1e-9 if len(s) > NEAREST else 0.0
            hit = np.flatnonzero((s > 0) & (s >= least))
            scores = np.concatenate([scores, np.round(s[hit], 12)])
            rows = np.concatenate([rows, self.seat[visit[hit // BLOCK] * BLOCK + hit % BLOCK]])
            best = np.lexsort((rows, -scores))[:NEAREST]
            scores, rows = scores[best], rows[best]
            at, step = at + step, step * 8
        return scores, rows

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> float:
        """Votes weighted by distance, drawn to the rate of label 1 by half a vote."""
        v = 1.0 / (0.05 + np.maximum(0.0, 1.0 - near[0]))
        return float((v * self.y[near[1]]).sum() + 0.5 * self.rate) / float(v.sum() + 0.5)


def monotone(pairs: list[tuple[float, float]], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """A monotone curve from votes to rates of label 1, by pooling adjacent violators; each pool leans on ``rate`` by one example."""
    pools: list[list[float]] = []
    for v, y in sorted(pairs):
        pools.append([y, 1.0, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2, v2 = pools.pop()
            p = pools[-1]
            pools[-1] = [p[0] + y2, p[1] + n2, (p[2] * p[1] + v2 * n2) / (p[1] + n2)]
    return np.array([p[2] for p in pools]), np.array([(p[0] + rate) / (p[1] + 1) for p in pools])


class Model:
    """Examples (doc_id, words, label) made into an index and a curve; ``scores`` gives texts' scores and their evidence."""

    def __init__(self, examples: Iterable[Example]):
        coded = Coded(examples)
        rows, place = coded.rows, coded.place
        self.ids = [e[0] for e in rows]
        self.index = Index(place, rows)
        pairs = []
        for part in range(SPLITS):
            others = Index(place, [e for k, e in enumerate(rows) if k % SPLITS != part])
            mine = [(others.coded(ids.astype(np.int64), tf.astype(float)), y) for _, ids, tf, y in rows[part::SPLITS]]
            mine = [x for x in mine if len(x[0][0])]
            for k in range(0, len(mine), TOGETHER):
                some = mine[k : k + TOGETHER]
                for (v, y), base in zip(some, others.shared([v for v, _ in some])):
                    pairs.append((others.vote(others.nearest(*v, base)), y))
        both = 0 < self.index.rate < 1
        self.curve = monotone(pairs, self.index.rate) if both else (np.zeros(0), np.zeros(0))
        self.names = list(place)
        self.memo: dict[bytes, tuple] = {}

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """Score, doc_ids of the nearest examples, and the words that speak for label 1, the strongest first, of each text."""
        keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        out: dict[bytes, tuple] = {k: self.memo[k] for k in keys if k in self.memo}
        new = {k: t for k, t in zip(keys, texts) if k not in out}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        for at in range(0, len(new), TOGETHER):
            some = list(new)[at : at + TOGETHER]
            vectors = [self.index.vector(words(new[k])) for k in some]
            for k, v, base in zip(some, vectors, self.index.shared(vectors)):
                out[k] = self.memo[k] = self._score(*v, base)
        return [out[k] for k in keys]

    def _score(self, t: np.ndarray, w: np.ndarray, base: np.ndarray) -> tuple[float, list[int], list[str]]:
        x, y = self.curve
        if not len(t) or not len(x):
            return self.index.rate, [], []
        near = self.index.nearest(t, w, base)
        vote = self.index.vote(near)
        # The vote itself breaks ties inside a pool, so that scores rank.
        score = min(1.0, max(0.0, 0.98 * float(np.interp(vote, x, y)) + 0.02 * vote))
        told = np.flatnonzero(self.index.told[t] > 0)
        told = told[np.argsort(-w[told], kind="stable")]
        return score, [self.ids[k] for k in near[1].tolist()], [self.names[k] for k in t[told].tolist()]


def examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> Iterator[Example]:
    """At most ``limit`` labelled texts from outside the held-out fold, drawn by a hash of doc_id, as counts of words."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "toxic").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    for r in texts.toLocalIterator():
        yield r["doc_id"], words(r["text"]), r["toxic"]


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES, evidence: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row (``evidence``: nearest examples and terms too)."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(examples(docs, labels, limit)))
    schema = "doc_id long, held_out boolean, score double, predicted int" + ", nearest array<long>, terms array<string>" * evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            got = m.scores(b.column(1).to_pylist())
            out = [b.column(0), pa.array([held_out(i) for i in ids]), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= CUTOFF) for g in got], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if evidence:
                out += [pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))]
                names += ["nearest", "terms"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
