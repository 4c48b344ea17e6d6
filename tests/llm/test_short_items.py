"""Test items with few characters are found, at word boundaries."""

import random

import pytest

from lumenlog.llm.decontam import Matcher, decontaminate, least_distance, masks, normal


@pytest.mark.parametrize(
    "item,text,found",
    [
        ("2 + 2?", "So what is 2 2 then", 0),
        ("Ion", "an ion moves", 0),
        ("Ion", "ion", 0),
        ("Ion", "a motion of ions", None),
        ("who wrote emma", "Q: Who wrote Emma? Austen.", 0),
        ("who wrote emma", "who wrote emmy", 1),
        ("who wrote emma", "who writes emma", None),
        ("???", "what???", None),
    ],
)
def test_short_items(item, text, found):
    got = Matcher([(1, item)]).matches(text)
    assert got == ([] if found is None else [(1, found, len(normal(item)))])


def test_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        items = [(n, "".join(rng.choices("ab c", k=rng.randint(1, 50)))) for n in range(3)]
        text = "".join(rng.choices("ab c", k=rng.randint(1, 60)))
        text = text + rng.choice(["", " "]) + rng.choice(items)[1] + rng.choice(["", " ", "a"])
        expect = []
        for n, t in items:
            t, whole = normal(t), normal(text)
            pattern, inside = (f" {t} ", f" {whole} ") if len(t) < 24 else (t, whole)
            d = least_distance(masks(pattern), len(pattern), inside)
            if t and whole and d <= int(len(t) * 0.1):
                expect.append((n, d, len(t)))
        assert sorted(Matcher(items).matches(text)) == expect


def test_decontaminate_drops_documents_with_short_items(spark):
    docs = spark.createDataFrame([(1, "Is it so? Who wrote Emma?"), (2, "Nobody asked.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "who wrote emma")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate(docs, items).collect()] == [2]
