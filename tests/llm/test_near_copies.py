"""Near copies against brute force."""

import random
import re

import pytest

import corpus_pipeline
from lumenlog.llm import nearcopies

NEAR = dict(corpus_pipeline.STAGES)["near_dedup"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"\S+", (t or "").lower())) else set() for t in (a, b))
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def near_rows(rng):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    line = rng.choices(words, k=30)
    texts = [None, "", " ", "one two", "One  two", "one three"]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([8, 30, 90, 250])) + line * rng.randint(0, 1)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("chunk", [8 << 20, 5000])
def test_near_dedup_is_by_similarity(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearcopies, "CHUNK_BYTES", chunk)
    texts = near_rows(random.Random(5))
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if up[a] != up[b] and similar(texts[a], texts[b]):
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    docs = spark.createDataFrame([(n, t, "en", "s", 0) for n, t in enumerate(texts)], SCHEMA)
    got = NEAR(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(up))
    assert len(set(up)) < len(texts) - 20 and NEAR(spark, docs.limit(0), "").count() == 0


def test_near_dedup_drops_a_copy_with_one_word_more(spark):
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("abcdefghijk", k=5)) for _ in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (101, text + " More.", "en", "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in NEAR(spark, docs, "").collect()] == [1]
