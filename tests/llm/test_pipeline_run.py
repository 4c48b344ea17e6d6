"""The whole pipeline against brute force: which documents stay, with which text, and how much of them is taken."""

import random

import corpus_pipeline
from lumenlog.llm import quality
from test_corpus import brute_substrings, brute_targets
from test_near_copies import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    items, passage = [prose(30) for _ in range(3)], prose(40)
    texts = [prose(rng.randint(60, 120)) for _ in range(40)]
    for k in range(12):
        ws = texts[k].split(" ")
        ws[rng.randrange(len(ws) - 1)] = rng.choice(words)
        texts.append(" ".join(ws))
    texts += [texts[3], texts[3], None, "", "too short."] + [prose(50) + "\n" + x + "\n" + prose(40) for x in (items[0], items[2], passage, passage)]
    rows = [(n, t, "en", "abc"[n % 3], len(t or "")) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # The verdicts of the rules have SQL of their own; what they clean is taken from the stage.
    kept = {r["doc_id"] for r in quality.quality_report(docs).filter("kept").collect()}
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert set(stage) <= kept and kept - set(stage) == set()
    up = {n: n for n in stage}
    for b in sorted(stage):
        for a in sorted(stage):
            if a < b and up[a] != up[b] and similar(stage[a], stage[b]):
                low, high = sorted((up[a], up[b]))
                up = {k: low if x == high else x for k, x in up.items()}
    stage = {n: t for n, t in stage.items() if up[n] == n}
    seen, left = set(), {}
    for n in sorted(stage):
        raw, gone = stage[n].encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        rest = bytes(c for i, c in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
        if rest:
            left[n] = rest
    assert len(brute_substrings(list(stage.items()))) == len(stage)
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    left = {n: t for n, t in left.items() if not any(plain(x) in plain(t) for x in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left)
    size = {}
    for n, t in left.items():
        assert got[n]["size"] == len(t.split())
        size["abc"[n % 3]] = size.get("abc"[n % 3], 0) + len(t.split())
    expect, taken = brute_targets(size), dict.fromkeys(size, 0)
    for n, r in got.items():
        taken["abc"[n % 3]] += r["taken"]
        assert abs(r["target"] - expect["abc"[n % 3]]) < 1e-6 and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - expect[s]) <= 120 for s in size)
