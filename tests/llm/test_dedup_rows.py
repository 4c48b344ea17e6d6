"""Dedup over tables with repeated and null doc_id."""

import random

from lumenlog.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, dedup):
    a, b, c = ("".join(random.Random(n).choices("abcdefgh ", k=400)) for n in range(3))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = dedup(docs.repartition(3)).select("doc_id", "text").collect()
    return sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (None, c), (5, None)], key=str)


def test_simhash_dedup_keeps_one_row_of_each_group(spark):
    assert kept(spark, simhash.dedup)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    assert kept(spark, nearcopies.dedup)
