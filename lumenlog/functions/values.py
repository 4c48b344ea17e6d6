"""Typed columns and the conversions that query expressions make."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOL, TIME, DURATION, NULL = "number", "string", "bool", "time", "duration", "null"

NAN = float("nan")
INF = float("inf")
#: What a time that can't be read becomes.
MIN_TIME = "timestamp_ntz'0001-01-01 00:00:00'"
NUMERIC_TEXT = r"^[\s]*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[\s]*$"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    #: Whether a number may be NaN or a truth null; where not, no guards are needed.
    nan: bool = True


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(data_type, T.DayTimeIntervalType):
        return DURATION
    if isinstance(data_type, T.NullType):
        return NULL
    return STRING


def from_field(col: Column, data_type: T.DataType) -> Value:
    """A field as the language sees it: all numbers are doubles, all times have no zone."""
    kind = kind_of(data_type)
    if kind == NUMBER:
        return Value(col if isinstance(data_type, T.DoubleType) else col.cast("double"), kind, isinstance(data_type, (T.DoubleType, T.FloatType)))
    if kind == TIME:
        return Value(col if isinstance(data_type, T.TimestampNTZType) else col.cast("timestamp_ntz"), kind)
    if kind == DURATION:
        return Value(col.cast("interval day to second"), kind)
    if kind == STRING and not isinstance(data_type, T.StringType):
        return Value(F.to_json(col) if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)) else col.cast("string"), kind)
    return Value(col, kind)


def parse_number(col: Column) -> Column:
    """A double from text, null where it isn't a plain number."""
    return F.when(col.rlike(NUMERIC_TEXT), F.trim(col).try_cast("double"))


#: Fixed value: the most days that a duration can have.
MOST_DAYS = 10675199


def parse_duration(col: Column) -> Column:
    """``d`` or ``[d.]hh:mm[:ss[.fffffff]]`` as an interval; zero where it is neither, or over ``MOST_DAYS``."""
    rx = r"^\s*(-)?(?:(0*\d{1,8})|(?:(0*\d{1,8})\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,7}))?)?)\s*$"

    def part(n: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(col, rx, n), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))

    fraction = F.rpad(F.regexp_extract(col, rx, 7), 7, "0").cast("bigint") / 10
    micros = ((part(2) + part(3)) * 86400 + part(4) * 3600 + part(5) * 60 + part(6)) * 1000000 + F.floor(F.coalesce(fraction, F.lit(0.0))).cast("bigint")
    good = col.rlike(rx) & (part(2) + part(3) <= MOST_DAYS) & (part(4) < 24) & (part(5) < 60) & (part(6) < 60)
    signed = F.when(F.regexp_extract(col, rx, 1) == "-", -micros).otherwise(micros)
    return from_micros(F.when(F.coalesce(good, F.lit(False)), signed).otherwise(F.lit(0).cast("bigint")))


def from_micros(micros: Column) -> Column:
    """An interval of so many microseconds."""
    seconds = micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(8,0)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def to_micros(interval: Column) -> Column:
    """Microseconds of an interval, exactly."""
    day = F.date_part(F.lit("day"), interval).cast("bigint")
    hour = F.date_part(F.lit("hour"), interval).cast("bigint")
    minute = F.date_part(F.lit("minute"), interval).cast("bigint")
    second = F.date_part(F.lit("second"), interval).cast("decimal(18,6)")
    return ((day * 24 + hour) * 60 + minute) * 60000000 + (second * 1000000).cast("bigint")


_RUNS = {"f": "S", "F": "S", "tt": "a", "t": "a", "ddd": "EEE", "dddd": "EEEE", "K": "XXX", "zzz": "XXX", "zz": "X", "z": "X"}


def java_format(fmt: str) -> str:
    """A .NET date format as a pattern that Spark understands."""
    out, at = "", 0
    while at < len(fmt):
        c = fmt[at]
        if c in "'\"":
            end = fmt.find(c, at + 1)
            end = len(fmt) if end < 0 else end
            out += "'" + fmt[at + 1 : end].replace("'", "''") + "'"
            at = end + 1
        elif c == "\\" and at + 1 < len(fmt):
            out += "'" + fmt[at + 1].replace("'", "''") + "'"
            at += 2
        elif c.isalpha():
            end = at
            while end < len(fmt) and fmt[end] == c:
                end += 1
            run = fmt[at:end]
            if run in _RUNS:
                out += _RUNS[run]
            elif c in "fF":
                out += "S" * len(run)
            elif c in "yMdHhms":
                out += run
            else:
                out += "'" + run + "'"
            at = end
        else:
            out += c
            at += 1
    return out


def is_date_format(fmt: str) -> bool:
    """Whether text is a .NET date format: parts of a date, no other letters outside quotes."""
    bare = re.sub(r"'[^']*'|\"[^\"]*\"|\\.", "", fmt)
    letters = {c for c in bare if c.isalpha()}
    return bool(letters & set("yMdHhms")) and letters <= set("dfFgGHhKmMstTyzZ")


DEFAULT_TIME = "yyyy-MM-dd HH:mm:ss,fff"


def parse_time(col: Column, fmt: str = DEFAULT_TIME) -> Column:
    """A time in the given .NET format; the least date where it can't be read."""
    return F.coalesce(F.try_to_timestamp(col, F.lit(java_format(fmt))).cast("timestamp_ntz"), F.expr(MIN_TIME))


def number_text(col: Column) -> Column:
    """Doubles as text: whole numbers without a fraction."""
    whole = (F.abs(col) < 1e15) & (col == F.floor(col))
    return F.when(F.isnan(col), F.lit("NaN")).when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def as_text(v: Value) -> Column:
    return number_text(v.col) if v.kind == NUMBER else v.col if v.kind == STRING else v.col.cast("string")


def convert(v: Value, kind: str) -> Value:
    """The value as another kind; what can't be converted is null."""
    if v.kind == kind:
        return v
    if v.kind == NULL:
        cast = {NUMBER: "double", STRING: "string", BOOL: "boolean", TIME: "timestamp_ntz", DURATION: "interval day to second"}[kind]
        return Value(v.col.cast(cast), kind)
    if kind == NUMBER:
        if v.kind == STRING:
            return Value(parse_number(v.col), kind)
        return Value(v.col.cast("double") if v.kind == BOOL else F.lit(None).cast("double"), kind)
    if kind == STRING:
        return Value(as_text(v), kind)
    if kind == BOOL:
        if v.kind == STRING:
            return Value(F.when(F.lower(F.trim(v.col)) == "true", F.lit(True)).when(F.lower(F.trim(v.col)) == "false", F.lit(False)), kind)
        return Value(v.col != 0 if v.kind == NUMBER else F.lit(None).cast("boolean"), kind)
    if kind == TIME and v.kind == STRING:
        return Value(parse_time(v.col), kind)
    if kind == DURATION and v.kind == STRING:
        return Value(parse_duration(v.col), kind)
    return Value(F.lit(None).cast("timestamp_ntz" if kind == TIME else "interval day to second"), kind)


def common(a: Value, b: Value) -> tuple[Value, Value]:
    """Both values as one kind: text gives way to the other side's kind."""
    if a.kind == b.kind:
        return a, b
    for kind in (NULL, STRING):
        if a.kind == kind:
            return convert(a, b.kind), b
        if b.kind == kind:
            return a, convert(b, a.kind)
    if {a.kind, b.kind} == {NUMBER, BOOL}:
        return convert(a, NUMBER), convert(b, NUMBER)
    return convert(a, STRING), convert(b, STRING)
