"""Search trees -> a condition and the columns that its phrases capture.

A line matches a phrase when its tokens hold the phrase's tokens and the pattern
matches; both are regular expressions behind plain ``contains`` tests that spare
most lines. Captures and markers have values only where their branch matched:
``or`` takes the first branch that did, ``not`` gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.values import NUMBER, STRING, TIME, Value, is_date_format, parse_number, parse_time
from lumenlog.operators.pattern import compile_pattern
from lumenlog.plans.syntax import Combined, Not, Phrase, Scan


#: The struct that holds what captures took from a line.
RAW = "__raw"


@dataclass
class Match:
    condition: Column | None  # None: every line
    fields: dict[str, Value] = field(default_factory=dict)
    #: What captured numbers must satisfy besides, where captures are taken once (``raws``).
    late: list[Column] = field(default_factory=list)


def _phrase(node: Phrase, text: Column, raws: list[Column] | None) -> Match:
    p = compile_pattern(node.pattern)
    if not p.needles:
        text = F.coalesce(text, F.lit(""))  # only phrases without tokens can match an empty line
    tests = [text.contains(n) for n in p.needles]
    # A lone token's boundary test would follow from the pattern only where the pattern is no more than it.
    tests += [text.rlike(t) for t in p.token_tests]
    if p.regex:
        tests.append(text.rlike(p.regex))
    fields: dict[str, Value] = {}
    late: list[Column] = []
    # The last format given in a phrase holds for all its times.
    formats = [c.kind for c in p.captures if c.kind not in ("string", "number", "time")]
    for c in p.captures:
        raw = F.regexp_extract(text, p.regex, c.group)
        if raws is not None:
            raws.append(raw.alias(f"r{len(raws)}"))
            raw = F.col(f"{RAW}.r{len(raws) - 1}")
        if c.kind == "string":
            fields[c.name] = Value(raw, STRING)
        elif c.kind == "number":
            number = parse_number(raw)
            (tests if raws is None else late).append(number.isNotNull())
            fields[c.name] = Value(number, NUMBER)
        else:
            if c.kind != "time" and not is_date_format(c.kind):
                raise QueryError(f"unknown capture type {c.kind!r}")
            fields[c.name] = Value(parse_time(raw, formats[-1]) if formats else parse_time(raw), TIME)
    if node.marker:
        fields[node.marker] = Value(F.lit(node.value), STRING)
    return Match(reduce(lambda a, b: a & b, tests) if tests else None, fields, late)


def compile_match(node: object, text: Column, top: bool = True, raws: list[Column] | None = None) -> Match:
    """``text`` may be null: a null line is empty. Where a condition only filters (``top``) null is as good as false.

    With ``raws``, a list to be filled, the captures of phrases that must all match are put there, to be
    taken once per line into a struct ``RAW``, which the fields and ``late`` then read.
    """
    if isinstance(node, Scan):
        return Match(None)
    if isinstance(node, Phrase):
        return _phrase(node, text if top else F.coalesce(text, F.lit("")), raws if top else None)
    if isinstance(node, Not):
        inner = compile_match(node.inner, text, False)
        return Match(F.lit(False) if inner.condition is None else ~inner.condition)
    if not isinstance(node, Combined):
        raise QueryError(f"{node!r} can't be searched for")
    parts = [compile_match(p, text, top and node.op == "and", raws) for p in node.parts]
    conditions = [F.lit(True) if p.condition is None else p.condition for p in parts]
    if node.op == "and":
        fields: dict[str, Value] = {}
        for p in parts:
            _agree(fields, p.fields)
            fields |= p.fields
        return Match(reduce(lambda a, b: a & b, conditions), fields, [x for p in parts for x in p.late])
    fields = {}
    for p in parts:
        _agree(fields, p.fields)
        fields |= {k: v for k, v in p.fields.items() if k not in fields}
    ladder: dict[str, Value] = {}
    for name, first in fields.items():
        col = None
        for c, p in zip(conditions, parts):
            value = p.fields[name].col if name in p.fields else F.lit(None)
            col = F.when(c, value) if col is None else col.when(c, value)
        ladder[name] = Value(col, first.kind)
    op = (lambda a, b: a | b) if node.op == "or" else (lambda a, b: a != b)
    return Match(reduce(op, conditions), ladder)


def _agree(a: dict[str, Value], b: dict[str, Value]) -> None:
    for name in a.keys() & b.keys():
        if a[name].kind != b[name].kind:
            raise QueryError(f"{name!r} is captured with two types")
