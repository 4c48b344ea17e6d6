"""Operators over whole corpora, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import graph, induced, lm, mixing, simhash, suffix
from lumenlog.llm.common import folded

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def frame(spark, rows):
    """(doc_id, text, source) with an extra column that clashes with inner names."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, chunk string")


def near_texts(rng, n):
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(200)]
    out = [None, "", " ", "one", "One", "a b c", "A B  C", "a b c d"]
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([3, 40, 200, 400]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def brute_fingerprint(t):
    ws = WORD.findall(lower((t or "").encode()))
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [4000, 2])
def test_simhash(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, bits: 6 if hot > 2 else 7)
    texts = near_texts(random.Random(4), 60)
    docs = frame(spark, [(n, t, "s") for n, t in enumerate(texts)])
    fps = {n: brute_fingerprint(t) for n, t in enumerate(texts)}
    expect = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {n: (f"{fps[n]:016x}", expect[n]) for n in fps}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(expect.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(n, n + 1) for n in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7), (3, 2)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[n] == 0 for n in range(61))
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    assert all(got[n] == min(up[n]) for n in got)


def test_every_close_pair_shares_blocks():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**7, 10**9, 10**11)] == [6, 6, 7, 8, 9]
    rng = random.Random(9)
    for blocks in (6, 7, 8, 10):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << k
            assert any((a ^ b) & m & (1 << 64) - 1 == 0 for m in masks)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for it in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint8)
        if it % 3 == 0:
            t = np.tile(t[:4], 12)
        b, sa = bytes(t), induced.suffix_array(t)
        assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = induced.permuted_prefixes(t, sa)
        for x, y in zip(sa, sa[1:]):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert lcp[y] == n


def test_wide_alphabets():
    """Strings of many names, with runs and repeats, as the recursion meets them."""
    rng = np.random.default_rng(3)
    for it in range(60):
        n, sigma = int(rng.integers(2, 3000)), int(rng.integers(2, 4000))
        t = rng.integers(0, sigma, n)
        if it % 3 == 0:
            t = np.repeat(t, rng.integers(1, 9, n))[:3000]
        if it % 5 == 0:
            t = np.tile(t[: max(2, n // 7)], 8)[:3000]
        words = np.ascontiguousarray(t.astype(">u4"))
        b = words.tobytes()
        assert list(induced.suffix_array(t.astype(np.int32), sigma)) == sorted(range(len(t)), key=lambda i: b[4 * i :])


def test_recursion_at_the_size_of_a_shard(monkeypatch):
    """Four MB of documents are ordered by recursion on names alone, and rightly."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 3000").fetchall()
    raw = "".join(x for x, in texts).encode()[: 4 << 20]
    depth, own = [], induced.suffix_array
    monkeypatch.setattr(induced, "suffix_array", lambda t, sigma=256: depth.append((len(t), sigma)) or own(t, sigma))
    t = np.frombuffer(raw, np.uint8)
    sa = induced.suffix_array(t)
    assert len(depth) > 2 and depth[1][1] > 6000 and all(2 * b <= a for (a, _), (b, _) in zip(depth, depth[1:]))
    assert len(np.unique(sa)) == len(t)
    # Neighbours are in order: equal up to the common prefix, and smaller there.
    lcp = induced.permuted_prefixes(t, sa)[sa[1:]]
    x, y = sa[:-1] + lcp, sa[1:] + lcp
    inside = x < len(t)
    assert (y < len(t)).all() and (t[x[inside]] < t[y[inside]]).all()


def brute_substrings(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone.update(range(i, i + length))
            seen.add(w)
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        out.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, chunk", [(5000, 2 << 20), (2, 3000)])
def test_suffix_dedup(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    rng = random.Random(6)
    passages = ["".join(rng.choices("abé dc\n", k=rng.randint(60, 400))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 350), (4, "ab" * 120), (5, "x" * 100), (6, "é" * 120), (None, passages[0]), (7, "y" * 40), (7, "y" * 140), (7, "y" * 140)]
    for n in range(8, 60):
        parts = ["".join(rng.choices("abcdefg ", k=rng.randint(0, 150))) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        rows.append((n, "".join(parts)))
    rows += [(100 + n, rows[20 + n % 3][1]) for n in range(12)]
    docs = frame(spark, [(*r, "s") for r in rows])
    got = suffix.suffix_dedup(docs, hot=hot).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_substrings(rows)))
    text = suffix.rewrite(docs)
    assert text.columns == docs.columns and text.count() == sum(r[1] > r[2] or r[1] == 0 for r in brute_substrings(rows))
    assert suffix.suffix_dedup(docs.limit(0)).count() == 0 and suffix.rewrite(docs.limit(0)).count() == 0


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdE", k=rng.randint(1, 4))) for _ in range(80)]

    def text():
        out = [rng.choice(words)]
        for _ in range(rng.randint(0, 120)):
            out.append(words[(words.index(out[-1]) + 1) % 80] if rng.random() < 0.6 else rng.choice(words))
        return " ".join(out)

    rows = [(n, text()) for n in range(200)] + [(900, None), (901, ""), (902, "zzz unknown"), (5, "twice"), (5, "twice"), (None, "no id")]
    toks = [(d, [lower(w) for w in WORD.findall((t or "").encode())] + [b" "]) for d, t in rows]
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    c = Counter(w for d, ws in toks if train(d) for w in ws)
    n_all, kinds = sum(c.values()), len(c)
    base = sorted(repr((d, not train(d), len(ws), sum(c[w] > 0 for w in ws), n_all, round(sum(math.log10((c[w] + 1) / (n_all + kinds + 1)) for w in ws), 6))) for d, ws in toks)
    got = lm.lm_scores(frame(spark, [(*r, "s") for r in rows])).collect()
    assert sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == base
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.95
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.lm_scores(frame(spark, [])).count() == 0


def test_lm_against_brute_force(spark, monkeypatch):
    """Counts, weights and scores by plain loops; after each context the probabilities of all words sum to one."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 900)
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choices("aabbcdefgh", k=rng.randint(1, 12)))) for n in range(160)] + [(900, "a zz"), (901, None)]
    rows += [(n, "a b a") for n in (500, 500, 500)]
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    toks = [(d, [*(t or "").split(), "\n"]) for d, t in rows]
    one, two = Counter(), Counter()
    for d, ws in toks:
        if train(d):
            one.update(ws)
            two.update(zip(["\n", *ws], ws))
    n_all, kinds = sum(one.values()), len(one)
    bucket = lambda c: math.frexp(c)[1]
    held: dict[int, list] = {}
    for (h, w), k in two.items():
        c, pair, before = one[w] - 1, k - 1, one[h] - 1
        eighth = lambda x: 2 ** (round(8 * math.log2(x)) / 8)  # noqa: E731  counts are learned from in eighths of a power of two
        near = eighth(c) if c else 0.0
        held.setdefault(bucket(before), []).append(((1 / eighth(before / pair) if pair else 0.0, near / (n_all - 1), (near + 1) / (n_all + kinds)), k))

    def learn(cells, prior):
        w = [1 / 3] * 3
        for _ in range(lm.ROUNDS):
            mass = list(prior)
            for p, k in cells:
                total = sum(x * y for x, y in zip(w, p))
                mass = [m + k * x * y / total for m, x, y in zip(mass, w, p)]
            w = [m / sum(mass) for m in mass]
        return w

    shared = learn([c for cells in held.values() for c in cells], [0.01] * 3)
    mix = {b: learn(cells, [100 * x for x in shared]) for b, cells in held.items()}

    def p(h, w):
        m = mix.get(bucket(one[h]), shared)
        if one[h] == 0:
            m = mix.get(0, shared)
            m = [0.0, m[1] / (m[1] + m[2]), m[2] / (m[1] + m[2])]
        return m[0] * two[h, w] / max(1, one[h]) + m[1] * one[w] / n_all + m[2] * (one[w] + 1) / (n_all + kinds + 1)

    for h in one:
        assert abs(sum(p(h, w) for w in one) + p(h, "never") - 1) < 1e-9
    got = sorted((r["doc_id"], r["score"]) for r in lm.lm_scores(frame(spark, [(*r, "s") for r in rows])).collect())
    expect = [(d, sum(math.log10(p(h, w)) for h, w in zip(["\n", *ws], ws))) for d, ws in toks]
    assert len(got) == len(expect)
    for (d, x), (e, y) in zip(got, sorted(expect)):
        assert d == e and abs(x - y) < 1e-6 * max(1, abs(y)), (d, x, y)


def test_words_without_structural_collisions(spark):
    """A word of 1,024 letters that is its complement under a polynomial hash modulo 2^64."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    ids = [n for n in range(100) if zlib.crc32(str(n).encode()) % 7 != 2][0], [n for n in range(100) if zlib.crc32(str(n).encode()) % 7 == 2][0]
    got = {r["doc_id"]: r["n_known"] for r in lm.lm_scores(frame(spark, [(ids[0], a, "s"), (ids[1], b, "s")])).collect()}
    assert got == {ids[0]: 2, ids[1]: 1}


def test_repeated_rows_are_no_hot_key(spark, monkeypatch):
    """A third of all rows alike: chunks and blocks hold them as one, results as many."""
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choices("abcdefgh", k=80)), "s") for n in range(60)] + [(7, "u v w " * 30, "s")] * 5000 + [(8, "few", "s")] * 40 + [(None, None, "s")] * 30
    docs = frame(spark, rows).repartition(6)
    assert folded(docs).count() == 63
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.suffix_dedup(docs).filter("n_removed > 0 OR doc_id IN (7, 8) OR doc_id IS NULL").collect())
    assert got[7, 180, 180] == 4999 and got[8, 3, 0] == 40 and got[None, 0, 0] == 30
    kept = suffix.rewrite(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept}[7] <= 2 and {r["doc_id"]: r["count"] for r in kept}[None] == 30
    scores = lm.lm_scores(docs)
    assert scores.count() == len(rows) and scores.filter("doc_id = 7").select("train_tokens").distinct().count() == 1
    mixed = mixing.mix(docs)
    assert mixed.count() == len(rows)
    r = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert abs(r["t"] - r["g"]) <= 90


def test_simhash_odd_bits(spark):
    """Hot buckets link fingerprints three bits apart, and no farther."""
    nodes = spark.createDataFrame([(0, 0), (0b111, 1), (0b1111 << 10, 2)], "fp long, node long")
    assert {frozenset(r) for r in simhash.links(nodes, 3, 5, hot=0).collect()} == {frozenset((0, 1))}


def test_simhash_of_rows_without_id(spark):
    text = "one two three four five six seven"
    got = simhash.near_duplicates(frame(spark, [(None, text, "s"), (None, text, "s"), (4, "other words entirely here now", "s"), (None, "other words entirely here now", "s")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(4, 4)] and sorted(map(str, (r["component_id"] for r in got))) == ["4", "4", "None", "None"]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(n, " ".join(["w"] * rng.choice([0, 1, 5, 40, 41, 300])) or rng.choice([None, ""]), rng.choice(["a", "a", "a", "b", "c", "é", "zz", None])) for n in range(3000)]
    rows += [(3000, "w " * 3, "tiny"), (3001, None, "none"), (5, "w w", "a"), (5, "w w", "a")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    expect, taken = brute_targets(dict(size)), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - expect[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - expect[s]) <= 300, s
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_keeps_expectations(spark):
    """Over many documents of one kind, the share that gets one more copy is the fraction."""
    rows = [(n, "w " * (1 + n % 7), "a" if n % 3 else "b") for n in range(6000)]
    got = mixing.mix(frame(spark, rows)).filter("source = 'a'").withColumn("kind", F.col("size"))
    rate = got.select((F.first("target") / F.first("source_size")).alias("r")).first()["r"]
    for r in got.groupBy("kind").agg(F.avg("copies").alias("c")).collect():
        assert abs(r["c"] - rate) < 0.08


def test_pipeline(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    item = prose(40)
    shared = prose(60)
    rows = [(n, prose(80), "en", "s1", 0) for n in range(30)]
    rows += [(100, rows[0][1], "en", "s2", 0), (101, rows[1][1] + " " + prose(1), "en", "s2", 0), (102, "too short.", "en", "s2", 0), (103, None, "en", None, 0), (104, prose(50) + "\n" + item + "\n" + prose(30), "en", "s2", 0)]
    rows += [(110, prose(50) + "\n" + shared, "en", "s2", 0), (111, prose(50) + "\n" + shared, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    a = stages["quality_rules"](spark, docs, "")
    assert {r["doc_id"] for r in a.collect()} == {r[0] for r in rows} - {102, 103}
    b = stages["near_dedup"](spark, a, "")
    ids = {r["doc_id"] for r in b.collect()}
    assert 100 not in ids and set(range(30)) <= ids
    c = stages["substring_dedup"](spark, b, "")
    texts = {r["doc_id"]: r["text"] for r in c.collect()}
    assert shared[:100] in texts[110] and shared[20:140] not in texts[111] and texts[5] == rows[5][1] and c.columns == docs.columns
    from lumenlog.llm.decontam import decontaminate

    d = decontaminate(c, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in d.collect()} == set(texts) - {104}
    assert stages["mixing"](spark, d, "").count() == len(texts) - 1
