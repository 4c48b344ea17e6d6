"""Logs that grow: new lines of a folder run through the same queries.

Searches, parsers with fixed columns, filters and projections are stateless and
stream as they are. Groups keep their state in Spark's store; times can be binned
and bounded by a watermark. Queries that need the log's order or all of it at once
(limit, first, last, most, least, lists, json and csv discovery) run over a
snapshot instead: ``refresh`` says which files to read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlog.errors import QueryError
from lumenlog.functions.expressions import compile_expression, condition
from lumenlog.functions.values import Value, from_field
from lumenlog.operators.aggregates import single
from lumenlog.operators.match import compile_match
from lumenlog.plans.syntax import Aggregate, parse
from lumenlog.sources.files import changes, find

STREAMED = ("count", "sum", "mean", "min", "max")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the files of a folder as (file, message)."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("message"))


def transform(stream: DataFrame, text: str, message: str = "message", late: str | None = None, time: str | None = None) -> DataFrame:
    """A streaming DataFrame through a query; ``time`` names the field that ``late`` bounds."""
    q = parse(text)
    if q.parse and q.parse.parser != "test" or q.order or q.limit is not None:
        raise QueryError("parse, order by and limit need the whole log; query a snapshot instead")
    m = compile_match(q.search, F.col(message))
    df = stream if m.condition is None else stream.filter(m.condition)
    df = df.withColumns({n: v.col for n, v in m.fields.items()}) if m.fields else df
    kinds = {n: v.kind for n, v in m.fields.items()}
    if late and time:
        df = df.withColumn(time, F.col(f"`{time}`").cast("timestamp")).withWatermark(time, late)

    def resolve(name: str) -> Value:
        if name in df.columns:
            return from_field(F.col(f"`{name}`"), df.schema[name].dataType)
        return Value(F.lit(None), kinds.get(name, "null"))

    if q.where is not None:
        df = df.filter(condition(q.where, resolve))
    named = any(isinstance(i.value, Aggregate) for i in q.select or [])
    if not q.group and not named:
        return df.select(*[compile_expression(i.value, resolve).col.alias(i.name) for i in q.select]) if q.select else df
    aggs = []
    for i in q.select or []:
        if not isinstance(i.value, Aggregate) or i.value.name not in STREAMED:
            raise QueryError(f"{i.name} can't be kept up to date; query a snapshot instead")
        arg = None if i.value.arg is None else compile_expression(i.value.arg, resolve)
        aggs.append(single(i.value.name, arg, F.lit(0))[0].alias(i.name))
    keys = [compile_expression(i.value, resolve).col.alias(i.name) for i in q.group or []]
    return df.groupBy(*keys).agg(*aggs) if aggs else df.groupBy(*keys).count().drop("count")


def start(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Run into an in-memory table."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def on_change(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Call ``act`` with each batch of new rows."""
    writer = stream.writeStream.foreachBatch(act)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def refresh(spark: SparkSession, sources: list[str], before: list[tuple[str, object, int]]) -> tuple[list[tuple[str, object, int]], list[str], list[str]]:
    """(listing, files that went, files to read again) since an earlier listing."""
    now = find(spark, sources)
    return (now, *changes(before, now))
