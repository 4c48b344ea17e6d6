"""Scalar functions of the query language as column expressions, with a registry for more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.values import BOOL, DEFAULT_TIME, DURATION, INF, MIN_TIME, NAN, NULL, NUMBER, STRING, TIME, Value, convert, from_micros, java_format, parse_duration, parse_number, parse_time, to_micros
from lumenlog.operators.pattern import compile_pattern

#: Microseconds from 0001-01-01 to 1970-01-01.
EPOCH = 62135596800000000

_nan = lambda: F.lit(NAN)


def _math(f: Callable[[Column], Column]) -> Callable[[list[Value], list], Value]:
    """A function of one number; null gives NaN."""
    return lambda args, raw: Value(F.coalesce(f(convert(args[0], NUMBER).col), _nan()), NUMBER)


def _log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, F.lit(-INF)).otherwise(F.log(x))


def _sqrt(x: Column) -> Column:
    return F.when(x < 0, _nan()).otherwise(F.sqrt(x))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding to whole doubles: beyond 2^53 every double is whole."""
    return lambda x: F.when(F.abs(x) < float(2**53), f(x).cast("double")).otherwise(x)


def _pick(f: Callable[..., Column]) -> Callable[[list[Value], list], Value]:
    """The lesser or greater of two numbers: nulls are skipped, NaN wins, two nulls are NaN."""

    def run(args: list[Value], raw: list) -> Value:
        a, b = (convert(x, NUMBER).col for x in args)
        return Value(F.when(F.isnan(a) | F.isnan(b), _nan()).otherwise(F.coalesce(f(a, b), _nan())), NUMBER)

    return run


def _text(args: list[Value], k: int) -> Column:
    return convert(args[k], STRING).col


def _found(method: str) -> Callable[[list[Value], list], Value]:
    def run(args: list[Value], raw: list) -> Value:
        s = _text(args, 0)
        return Value(F.coalesce(getattr(s, method)(_text(args, 1)) & (s != ""), F.lit(False)), BOOL)

    return run


def _matches(args: list[Value], raw: list) -> Value:
    if not isinstance(raw[1], str):
        raise QueryError("matches needs a pattern in quotes")
    rx = compile_pattern(raw[1]).regex
    return Value(F.coalesce(_text(args, 0).rlike(rx), F.lit(False)) if rx else _text(args, 0).isNotNull(), BOOL)


def _time(args: list[Value], raw: list) -> Value:
    if len(args) == 2:
        if not isinstance(raw[1], str):
            raise QueryError("time needs a format in quotes")
        return Value(parse_time(_text(args, 0), raw[1]), TIME)
    return args[0] if args[0].kind == TIME else Value(parse_time(_text(args, 0), DEFAULT_TIME), TIME)


def bin_number(v: Column, size: Column) -> Column:
    """The nearest multiple, ties to even; a bin of nothing gives NaN."""
    return F.when(v.isNull(), F.lit(None).cast("double")).when(size.isNull() | (size == 0) | F.isnan(size), _nan()).otherwise(F.rint(v / size) * size)


def bin_time(v: Column, size: Column) -> Column:
    """The start of the bin, counted from 0001-01-01."""
    micros = to_micros(size)
    # Times without a zone are read as UTC to count from the epoch.
    at = F.unix_micros(F.to_utc_timestamp(v.cast("timestamp"), F.current_timezone())) + F.lit(EPOCH)
    start = at - F.pmod(at, micros) - F.lit(EPOCH)
    back = F.from_utc_timestamp(F.timestamp_micros(start), F.current_timezone()).cast("timestamp_ntz")
    return F.when(micros > 0, back)


def bin_duration(v: Column, size: Column) -> Column:
    """Whole bins of an interval, cut towards zero."""
    a, b = to_micros(v), to_micros(size)
    return F.when(b != 0, from_micros(a - a % b))


def _bin(args: list[Value], raw: list) -> Value:
    v, size = args
    if v.kind == STRING and size.kind != NUMBER:
        v = convert(v, TIME)
    if v.kind == TIME:
        return Value(bin_time(v.col, size.col if size.kind == DURATION else parse_duration(convert(size, STRING).col)), TIME)
    if v.kind == DURATION:
        return Value(bin_duration(v.col, size.col if size.kind == DURATION else parse_duration(convert(size, STRING).col)), DURATION)
    return Value(bin_number(convert(v, NUMBER).col, convert(size, NUMBER).col), NUMBER)


def _pow(args: list[Value], raw: list) -> Value:
    a, b = (convert(x, NUMBER).col for x in args)
    return Value(F.coalesce(F.pow(a, b), _nan()), NUMBER)


_BLANK = r"[\s\p{Z}\x1C-\x1F\x85﻿]"

#: name -> (least arguments, most arguments, function of the values and of the literals they come from).
FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Value], list], Value]]] = {
    "bin": (2, 2, _bin),
    "number": (1, 1, lambda a, raw: convert(a[0], NUMBER)),
    "duration": (1, 1, lambda a, raw: a[0] if a[0].kind == DURATION else Value(parse_duration(_text(a, 0)), DURATION)),
    "time": (1, 2, _time),
    "contains": (2, 2, _found("contains")),
    "startswith": (2, 2, _found("startswith")),
    "endswith": (2, 2, _found("endswith")),
    "matches": (2, 2, _matches),
    "trim": (1, 1, lambda a, raw: Value(F.coalesce(F.regexp_replace(_text(a, 0), f"^{_BLANK}+|{_BLANK}+$", ""), F.lit("")), STRING)),
    "length": (1, 1, lambda a, raw: Value(F.length(_text(a, 0)).cast("double"), NUMBER)),
    "abs": (1, 1, _math(F.abs)),
    "sqrt": (1, 1, _math(_sqrt)),
    "sin": (1, 1, _math(F.sin)),
    "cos": (1, 1, _math(F.cos)),
    "tan": (1, 1, _math(F.tan)),
    "log": (1, 1, _math(_log)),
    "exp": (1, 1, _math(F.exp)),
    "round": (1, 1, _math(F.rint)),
    "ceil": (1, 1, _math(_whole(F.ceil))),
    "floor": (1, 1, _math(_whole(F.floor))),
    "trunc": (1, 1, _math(_whole(lambda x: F.signum(x) * F.floor(F.abs(x))))),
    "min": (2, 2, _pick(F.least)),
    "max": (2, 2, _pick(F.greatest)),
    "pow": (2, 2, _pow),
}


def register(name: str, least: int, most: int, function: Callable[[list[Value], list], Value]) -> None:
    """Add a scalar function to the language."""
    FUNCTIONS[name] = (least, most, function)


def call(name: str, args: list[Value], raw: list) -> Value:
    if name not in FUNCTIONS:
        raise QueryError(f"no function {name!r}")
    least, most, f = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least}{f' to {most}' if most > least else ''} arguments, not {len(args)}")
    return f(args, raw)


__all__ = ["FUNCTIONS", "MIN_TIME", "NULL", "call", "java_format", "parse_number", "register"]
