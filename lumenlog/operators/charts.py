"""Results shaped for charts: samples, categories, labels, limits and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.errors import QueryError
from lumenlog.functions.values import kind_of, to_micros
from lumenlog.plans.engine import Result

CATEGORIES = 10
OTHER = "Other"
#: 100 ns ticks from 0001-01-01 to 1970-01-01.
EPOCH_TICKS = 621355968000000000


def _axis(df: DataFrame, name: str) -> Column:
    c, kind = F.col(f"`{name}`"), kind_of(df.schema[name].dataType)
    if kind == "time":
        return (F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())) * 10 + EPOCH_TICKS).cast("double")
    if kind == "duration":
        return to_micros(c) / 1e6
    if kind == "string":
        return c
    return c.cast("double")


def samples(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) pairs without nulls: text stays text, times are ticks, intervals seconds, all else doubles."""
    value = _axis(df, y)
    if isinstance(df.schema[y].dataType, T.StringType):
        value = F.col(f"`{y}`").try_cast("double")
    return df.select(_axis(df, x).alias("x"), value.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def categories(result: Result, x: str, y: str, most: int = CATEGORIES) -> DataFrame:
    """The first ``most`` rows in order, the others summed up as one."""
    rows = result.numbered("at").select("at", F.col(f"`{x}`").cast("string").alias("category"), F.col(f"`{y}`").cast("double").alias("amount"))
    rows = rows.filter("category IS NOT NULL AND amount IS NOT NULL")
    first = rows.filter(F.col("at") < most)
    rest = rows.filter(F.col("at") >= most).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    return first.unionByName(rest.select(F.lit(most).cast("bigint").alias("at"), F.lit(OTHER).alias("category"), "amount"))


def labels(df: DataFrame, x: str, ordered: bool = False) -> DataFrame:
    out = df.select(F.col(f"`{x}`").cast("string").alias("label")).filter("label IS NOT NULL").distinct()
    return out.orderBy("label") if ordered else out


def limits(df: DataFrame, *names: str) -> DataFrame:
    """One row: the least and greatest value over all series."""
    lows, highs = [F.min(F.col(f"`{n}`").cast("double")) for n in names], [F.max(F.col(f"`{n}`").cast("double")) for n in names]
    return df.agg((F.least(*lows) if len(lows) > 1 else lows[0]).alias("low"), (F.greatest(*highs) if len(highs) > 1 else highs[0]).alias("high"))


def shares(df: DataFrame, x: str, y: str) -> DataFrame:
    """Each category's part of the whole; the whole is one row that is added up first."""
    rows = df.select(F.col(f"`{x}`").alias("category"), F.col(f"`{y}`").cast("double").alias("amount"))
    total = rows.agg(F.sum("amount").alias("total")).withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("category", "amount", (F.col("amount") / F.col("total")).alias("share"))


def check(kind: str, df: DataFrame, axis: str) -> None:
    """Column and pie charts need a text axis, line, point and step charts one that isn't."""
    text = kind_of(df.schema[axis].dataType) == "string"
    if kind in ("column", "pie") and not text:
        raise QueryError(f"a {kind} chart needs a text axis")
    if kind in ("line", "step", "point") and text:
        raise QueryError(f"a {kind} chart can't have a text axis")
