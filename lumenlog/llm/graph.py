"""Connected components of an edge list by alternating large and small stars.

Every round is two joins and two aggregations over the edges; lineage is cut
into the shared folder, so a lost executor costs one round. Nothing but a count
and a checksum reaches the driver. Hot nodes are folded by partial ``min``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import cut, drop


def _star(directed: DataFrame) -> DataFrame:
    """directed: (u, v). For each u, m = least of u and its v's: all v get the edge (v, m)."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): component is the least node reachable.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        pairs = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _star(pairs)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        done, now = now, cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(done)
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = (got["n"], got["s"])
