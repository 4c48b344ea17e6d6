"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

Every document of a source has the same expected number of copies, its source's
target over its source's size. The whole part is taken; the fractions are
rounded dependently. Two fractional documents meet, and mass in words moves
from one to the other until one of them has a whole number of copies; which way
it moves is drawn so that every document's expectation stays what it was. Words
are conserved by each move. The document that is still fractional carries on; the
one that is left of a source in the end goes to the nearer whole number, so that a
source ends within half a document of its target.

The reduction tree: documents are dealt by a hash into blocks of about
``FAN`` within a source; each block is folded from its largest document down
and leaves at most one carrier; the carriers of ``FAN`` blocks form a block of
the next level, until one is left per source. A source
with a third of all rows only has more blocks. Levels grow with the logarithm
of the largest source. Draws are hashes of the documents that meet, so reruns
agree.

Edge cases: a null text has size 0 and is taken 0 words; null is a source of its
own, the last; sources of size 0 have target 0; repeated rows (same doc_id, source
and size) each get their copies, which of them get more isn't told apart: they are met
with each other by their number, so no task holds them one by one; an empty table gives an empty result; extra columns pass by unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.llm.common import cut, unfolded, words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
FAN = 64
SEED = 9

_UNIT = "struct<s: double, id: bigint, b: bigint, p: double, u: bigint>"
_DONE = "array<struct<id: bigint, s: double, t: bigint>>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size): weighted shares under a cap.

    The source-level table has one row per source; only that table is ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    per = per.select("source", "source_size", "n", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double").alias("w"))
    per = per.withColumn("top", cap * F.col("source_size").cast("double"))
    up = W.orderBy((F.col("top") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("top").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    whole = W.partitionBy(F.lit(1))
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    level = per.withColumn("level", (total - before) / left).withColumn("at", F.row_number().over(up))
    # The first source in this order that stays under its cap at its level sets the level for all after it.
    first = F.min(F.when(F.col("top") >= F.col("level") * F.col("w"), F.struct("at", "level"))).over(whole)
    return level.withColumn("first", first).select(
        "source", "source_size", "n", F.least(F.col("top"), F.coalesce(F.col("first.level") * F.col("w"), F.col("top"))).alias("target")
    )


def _fold(level: int) -> Column:
    """Fold the sorted array ``units``: {c: the carrier or null, out: documents that became whole}."""
    draw = f"(shiftrightunsigned(xxhash64(acc.c.u, x.u, {SEED}, {level}), 11) / 9007199254740992D)"
    # up: words that may move from x to the carrier; dn: from the carrier to x.
    up = "least((1D - acc.c.p) * acc.c.s, x.p * x.s)"
    dn = "least(acc.c.p * acc.c.s, (1D - x.p) * x.s)"
    gain = f"({draw} * ({up} + {dn}) < {dn})"

    def unit(name: str, p: str) -> str:
        return f"named_struct('s', {name}.s, 'id', {name}.id, 'b', {name}.b, 'p', {p}, 'u', {name}.u)"

    def done(name: str, t: str) -> str:
        return f"concat(acc.out, array(named_struct('id', {name}.id, 's', {name}.s, 't', {name}.b + {t})))"

    def both(carrier: str, out: str) -> str:
        return f"named_struct('c', cast({carrier} as {_UNIT}), 'out', cast({out} as {_DONE}))"

    fills = both(unit("x", "x.p - (1D - acc.c.p) * acc.c.s / x.s"), done("acc.c", "1L"))
    spent = both(unit("acc.c", "acc.c.p + x.p * x.s / acc.c.s"), done("x", "0L"))
    empties = both(unit("x", "x.p + acc.c.p * acc.c.s / x.s"), done("acc.c", "0L"))
    takes = both(unit("acc.c", "acc.c.p - (1D - x.p) * x.s / acc.c.s"), done("x", "1L"))
    step = (
        f"CASE WHEN acc.c IS NULL THEN {both('x', 'acc.out')} "
        f"WHEN {gain} AND (1D - acc.c.p) * acc.c.s <= x.p * x.s THEN {fills} WHEN {gain} THEN {spent} "
        f"WHEN acc.c.p * acc.c.s <= (1D - x.p) * x.s THEN {empties} ELSE {takes} END"
    )
    start = both("NULL", "array()")
    return F.expr(f"aggregate(units, {start}, (acc, x) -> {step})")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES, fan: int = FAN) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) of every row."""
    sized = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    goal = cut(targets(sized.select("source", "size"), weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    alike = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    rows = alike.join(goal, alike["source"].eqNullSafe(goal["source"])).select(
        "doc_id", alike["source"], "size", "times", "n", rate.alias("rate")
    )
    rows = rows.withColumn("b", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate"))
    fraction = (F.col("size") > 0) & (F.col("p") > 0)
    whole = rows.filter(~fraction).select("doc_id", "source", "size", F.col("b").alias("copies"), "times")
    # Rows alike, met with each other, leave so many with one more copy, so many without, and at most one carrier.
    rows = rows.filter(fraction).withColumn("up", F.floor(F.col("times") * F.col("p")).cast("long"))
    rows = rows.withColumn("p", F.col("times") * F.col("p") - F.col("up"))
    several = rows.filter("times > 1")
    met = [several.select("doc_id", "source", "size", (F.col("b") + 1).alias("copies"), F.col("up").alias("times")).filter("times > 0")]
    met.append(several.select("doc_id", "source", "size", F.col("b").alias("copies"), (F.col("times") - F.col("up") - (F.col("p") > 0).cast("long")).alias("times")).filter("times > 0"))
    n_max = goal.agg(F.max("n").alias("n")).first()["n"] or 0
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan)).cast("long")
    now = rows.filter("p > 0").select(
        "source", F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), blocks).alias("block"),
        F.struct(F.col("size").cast("double").alias("s"), F.col("doc_id").cast("long").alias("id"), "b", "p", F.xxhash64("doc_id", "size", F.lit(SEED)).alias("u")).alias("unit"),
    )
    one = F.lit(1).cast("long").alias("times")
    out, level, width = [whole, *met], 0, max(1, -(-n_max // fan))
    while True:
        met = now.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        met = cut(met.select("source", "block", _fold(level).alias("f")))
        settled = met.select("source", F.explode("f.out").alias("o"))
        out.append(settled.select(F.col("o.id").alias("doc_id"), "source", F.col("o.s").cast("long").alias("size"), F.col("o.t").alias("copies"), one))
        carried = met.filter("f.c IS NOT NULL").select("source", "block", F.col("f.c").alias("unit"))
        if width == 1:
            break
        now, level, width = carried.withColumn("block", F.floor(F.col("block") / fan).cast("long")), level + 1, -(-width // fan)
    last = F.col("unit.p") >= 0.5
    out.append(carried.select(F.col("unit.id").alias("doc_id"), "source", F.col("unit.s").cast("long").alias("size"), (F.col("unit.b") + last.cast("long")).alias("copies"), one))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    every = unfolded(every, alike)
    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    return every.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
