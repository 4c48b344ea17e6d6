"""Shared helpers of the corpus operators: reading tables, cutting lineage, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.shared import folder, remove

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that lineage ends there.

    The folder goes when the session's JVM ends, or by ``remove`` when its readers are done.
    """
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, after its last reader."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, name)


def folded(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for all rows alike in doc_id and text, and a column ``times``: how many they are.

    Which row's other columns stay isn't defined. Where no rows are alike, which 16 bytes a row tell, texts aren't moved.
    """
    keys = [F.col("doc_id"), F.xxhash64("text").alias("_h1"), F.xxhash64("text", F.lit(5)).alias("_h2")]
    if docs.select(*keys).groupBy("doc_id", "_h1", "_h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("times", F.lit(1).cast("long"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = docs.select(*keys, row.alias("_row")).groupBy("doc_id", "_h1", "_h2").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("times"))
    return cut(rows.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)], "times"))


#: Rows that one task makes of one folded row.
SPREAD = 4096


def unfolded(df: DataFrame, known: DataFrame | None = None, times: str = "times") -> DataFrame:
    """Each row as often as ``times`` says; many repeats are dealt over tasks. ``known`` tells whether there are any."""
    if (df if known is None else known).filter(F.col(times) > 1).isEmpty():
        return df.drop(times)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / SPREAD))).alias("_part")
    dealt = df.filter(F.col(times) > 1).select("*", parts).repartition("_part")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SPREAD).cast("long"), F.col(times) - F.col("_part") * SPREAD))).alias("_one")
    return df.filter(F.col(times) == 1).drop(times).union(dealt.select("*", again).drop("_part", "_one", times))


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: what partition counts are derived from."""
    got = docs.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()
    return int(got["b"] or 0)
