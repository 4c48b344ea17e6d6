"""What substring dedup sends to its shards: text that may repeat, not phrases that everyone uses."""

import random

import pyarrow as pa
import pyarrow.compute as pc

from lumenlog.llm import suffix

SHARDS, PARTS = 4, 3


def sent(chunks):
    """Runs that chunks of texts send to the shards, as bytes."""
    tables = [pa.table({"doc_id": pa.array(range(1000 * k, 1000 * k + len(c)), pa.int64()), "raw": pa.array(c, pa.binary())}) for k, c in enumerate(chunks)]
    keys = [(pa.scalar(k),) for k in range(len(chunks))]
    asked = pa.concat_tables(suffix._ask(PARTS, suffix.LENGTH, suffix.GRAM)(k, t) for k, t in zip(keys, tables))
    know = suffix._know(SHARDS, suffix.HOT)
    known = pa.concat_tables(know(None, asked.filter(pc.equal(asked["part"], p))) for p in range(PARTS))
    cut = suffix._cut(SHARDS, suffix.LENGTH, suffix.GRAM)
    return [b for k, t in zip(keys, tables) for b in cut(k, t, known.filter(pc.equal(known["chunk"], k[0])))["body"].to_pylist()]


def test_common_phrases_stay_in_their_chunks():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(40)]
    prose = lambda n: " ".join(rng.choices(words, k=n)).encode()
    passage = prose(40)
    chunks = [[prose(300) + b"\n" + (passage if n % 20 == 0 else b"") + prose(50) for n in range(40)] for _ in range(4)]
    bodies = sent(chunks)
    assert sum(passage[:100] in b for b in bodies) >= len(chunks)
    # Eight places of the passage with a window to each side.
    assert sum(map(len, bodies)) <= 8 * (len(passage) + 4 * suffix.LENGTH) < sum(len(t) for c in chunks for t in c) / 40
