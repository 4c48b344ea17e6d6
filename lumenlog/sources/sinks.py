"""Results as files: separated values with a header, tab-joined text, and single rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


def _text(df: DataFrame, time_format: str) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        time = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        out.append((F.date_format(c.cast("timestamp"), time_format) if time else c.cast("string")).alias(f.name))
    return out


def write_csv(df: DataFrame, path: str, time_format: str = TIME_FORMAT, separator: str = ";") -> None:
    """A header and rows of separated cells; cells that hold separators or quotes are quoted."""
    df.select(*_text(df, time_format)).write.option("sep", separator).option("header", True).option("escape", '"').csv(path)


def row_text(df: DataFrame, time_format: str = TIME_FORMAT) -> DataFrame:
    """One column ``value``: the cells of each row joined by tabs, nulls as empty cells."""
    cells = [F.coalesce(c, F.lit("")) for c in _text(df, time_format)]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_text(df: DataFrame, path: str, time_format: str = TIME_FORMAT) -> None:
    row_text(df, time_format).write.text(path)
