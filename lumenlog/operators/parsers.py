"""Line parsers of the ``parse`` stage: json, csv, test, and a registry for more.

A parser sees the log once to learn which columns there are (one aggregation) and
then turns lines into columns with expressions. Lines that don't parse keep their
fields; lines that do lose them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.values import BOOL, NUMBER, STRING, Value


@dataclass
class Parsed:
    good: Column  # whether a line parses
    fields: dict[str, Value]
    all_good: bool  # whether every line does


Parser = Callable[[DataFrame, Column, Column], Parsed]

_TYPE = re.compile(r"\s*(?:(OBJECT)<|(ARRAY)<|([A-Z]+)(?:\(\d+(?:,\s*\d+)?\))?)")


def _read_type(s: str, at: int = 0) -> tuple[object, int]:
    """A variant schema: {name: type} for objects, [type] for arrays, a name otherwise."""
    m = _TYPE.match(s, at)
    if not m:
        raise QueryError(f"can't read the JSON schema {s!r} at {at}")
    at = m.end()
    if m[2]:
        inner, at = _read_type(s, at)
        return [inner], at + 1
    if not m[1]:
        return m[3], at
    out: dict[str, object] = {}
    while s[at] != ">":
        if s[at] in ", ":
            at += 1
            continue
        if s[at] == "`":
            name, at = "", at + 1
            while s[at] != "`" or s[at + 1] == "`":
                name += s[at]
                at += 2 if s[at] == "`" else 1
            at += 1
        else:
            end = s.index(":", at)
            name, at = s[at:end], end
        out[name], at = _read_type(s, s.index(":", at) + 1)
    return out, at + 1


def _step(name: str) -> str:
    return '["' + name.replace('"', '\\"') + '"]'


def json_parser(log: DataFrame, text: Column, order: Column) -> Parsed:
    """Objects and arrays of JSON, flattened: ``a.b`` for members, ``a.0`` for elements."""
    v = F.try_parse_json(text)
    good = F.coalesce(text.rlike(r"^\s*[\[{]") & v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False)), F.lit(False))
    seen = log.select(F.when(good, v).alias("v"), good.alias("good"))
    # Objects and arrays at the top are learned apart, as they have no common schema.
    shapes = [F.schema_of_variant_agg(F.when(F.startswith(F.schema_of_variant("v"), F.lit(k)), F.col("v"))).alias(k) for k in ("OBJECT", "ARRAY")]
    got = seen.agg(*shapes, F.min("good").alias("all")).first()
    leaves: list[tuple[str, str, str]] = []
    pending: list[tuple[str, str, object]] = [("", "$", _read_type(got[k])[0]) for k in ("OBJECT", "ARRAY") if got[k] and got[k].startswith(k)]
    while pending:
        arrays: list[tuple[str, str, object]] = []
        for name, path, kind in pending:
            stack = [(name, path, kind)]
            while stack:
                n, p, k = stack.pop(0)
                if isinstance(k, dict):
                    stack = [(f"{n}.{x}" if n else x, p + _step(x), y) for x, y in k.items()] + stack
                elif isinstance(k, list):
                    arrays.append((n, p, k[0]))
                else:
                    leaves.append((n, p, k))
        pending = []
        if arrays:
            sizes = seen.agg(*[F.max(F.size(F.try_variant_get("v", p, "array<variant>"))).alias(f"s{i}") for i, (_, p, _) in enumerate(arrays)]).first()
            for i, (n, p, k) in enumerate(arrays):
                pending += [(f"{n}.{j}" if n else str(j), f"{p}[{j}]", k) for j in range(sizes[f"s{i}"] or 0)]
    fields: dict[str, Value] = {}
    for name, path, kind in leaves:
        if not name:
            continue
        spark_type, own = ("boolean", BOOL) if kind == "BOOLEAN" else ("double", NUMBER) if kind in ("BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT") else ("string", STRING)
        fields[name] = Value(F.try_variant_get(v, path, spark_type), own)
    return Parsed(good, fields, bool(got["all"]))


def csv_parser(log: DataFrame, text: Column, order: Column) -> Parsed:
    """Cells between semicolons; the first line of names is the header, lines equal to it aren't parsed."""
    cells = F.split(text, ";")
    names = F.forall(cells, lambda c: c.rlike(r"^[\p{L}\p{Nd}]+$")) & ~F.exists(cells, lambda c: c.rlike(r"^\p{Nd}+$"))
    row = log.select(F.min_by(text, F.when(names, order)).alias("header")).first()
    if row is None or row["header"] is None:
        return Parsed(F.lit(False), {}, False)
    header = row["header"].split(";")
    good = F.coalesce(text != row["header"], F.lit(False))
    fields = {name: Value(F.get(cells, k), STRING) for k, name in enumerate(header)}
    return Parsed(good, fields, False)


def test_parser(log: DataFrame, text: Column, order: Column) -> Parsed:
    """Three constants for every line."""
    return Parsed(F.lit(True), {"A": Value(F.lit(1.0), NUMBER), "B": Value(F.lit("2"), STRING), "C": Value(F.lit(3.1), NUMBER)}, True)


PARSERS: dict[str, Parser] = {"json": json_parser, "csv": csv_parser, "test": test_parser}


def register(name: str, parser: Parser) -> None:
    """Add a parser to the language."""
    PARSERS[name] = parser


def get(name: str) -> Parser:
    if name not in PARSERS:
        raise QueryError(f"no parser {name!r}")
    return PARSERS[name]
