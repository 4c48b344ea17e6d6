"""Expression trees of the query language -> typed columns.

Arithmetic follows IEEE doubles (x/0 is infinite, 0/0 and x%0 are NaN), equality
is two-valued (null equals null, NaN equals nothing), and comparisons with null
or NaN are false, where SQL differs in each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.scalar import call
from lumenlog.functions.values import BOOL, DURATION, INF, NAN, NULL, NUMBER, STRING, TIME, Value, common, convert
from lumenlog.plans.syntax import Binary, Call, Field, Literal, Unary

Resolve = Callable[[str], Value]


def _divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * INF)
    return F.when(b == 0, F.when(a.isNull(), F.lit(None).cast("double")).otherwise(zero)).otherwise(a / b)


def _remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) & a.isNotNull(), F.lit(NAN)).otherwise(a % b)


_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "%": _remainder, "^": F.pow}
_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def truth(v: Value) -> Column:
    """A condition that is never null."""
    return v.col if v.kind == BOOL and not v.nan else F.coalesce(convert(v, BOOL).col, F.lit(False))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    kinds = {a.kind, b.kind}
    if TIME in kinds or DURATION in kinds:
        if op == "-" and a.kind == TIME and b.kind in (TIME, STRING):
            return Value((a.col - convert(b, TIME).col).cast("interval day to second"), DURATION)
        if op in "+-" and a.kind == TIME:
            return Value(_ARITHMETIC[op](a.col, convert(b, DURATION).col), TIME)
        if op in "+-" and a.kind == DURATION and b.kind == DURATION:
            return Value(_ARITHMETIC[op](a.col, b.col), DURATION)
        if op == "+" and a.kind == DURATION and b.kind == TIME:
            return Value(b.col + a.col, TIME)
        raise QueryError(f"{op} isn't defined for {a.kind} and {b.kind}")
    return Value(_ARITHMETIC[op](convert(a, NUMBER).col, convert(b, NUMBER).col), NUMBER)


def _equal(a: Value, b: Value) -> Column:
    a, b = common(a, b)
    same = a.col.eqNullSafe(b.col)
    if a.kind == NUMBER and a.nan and b.nan:
        return same & ~F.coalesce(F.isnan(a.col), F.lit(False))
    return same


def _ordered(op: str, a: Value, b: Value) -> Column:
    """A comparison that is null or false where it doesn't hold."""
    a, b = common(a, b)
    if a.kind in (STRING, BOOL):
        if STRING == a.kind:
            # Text has no order here; numbers in text do.
            a, b = convert(a, NUMBER), convert(b, NUMBER)
        else:
            raise QueryError(f"{op} isn't defined for {a.kind}")
    good = _COMPARE[op](a.col, b.col)
    if a.kind == NUMBER:
        for side in (a, b):
            if side.nan:
                good = good & ~F.isnan(side.col)
    return good


def compile_expression(node: object, resolve: Resolve) -> Value:
    if isinstance(node, Literal):
        kind = BOOL if isinstance(node.value, bool) else NUMBER if isinstance(node.value, float) else STRING
        return Value(F.lit(node.value), kind, nan=False)
    if isinstance(node, Field):
        return resolve(node.name)
    if isinstance(node, Unary):
        inner = compile_expression(node.inner, resolve)
        if node.op == "not":
            return Value(~truth(inner), BOOL)
        if inner.kind == DURATION:
            return Value(-inner.col, DURATION)
        return Value(-convert(inner, NUMBER).col, NUMBER, inner.nan)
    if isinstance(node, Call):
        args = [compile_expression(a, resolve) for a in node.args]
        return call(node.name, args, [a.value if isinstance(a, Literal) else None for a in node.args])
    if isinstance(node, Binary):
        a, b = compile_expression(node.left, resolve), compile_expression(node.right, resolve)
        if node.op in _ARITHMETIC:
            return _arithmetic(node.op, a, b)
        if node.op == "==":
            return Value(_equal(a, b), BOOL, nan=False)
        if node.op == "!=":
            return Value(~_equal(a, b), BOOL, nan=False)
        if node.op in _COMPARE:
            return Value(F.coalesce(_ordered(node.op, a, b), F.lit(False)), BOOL, nan=False)
        x, y = truth(a), truth(b)
        return Value(x & y if node.op == "and" else x | y if node.op == "or" else x != y, BOOL)
    raise QueryError(f"{node!r} can't stand here")


def condition(node: object, resolve: Resolve) -> Column:
    """An expression as a filter: conjuncts stay apart and plain comparisons bare, so that scans can take them."""
    if isinstance(node, Binary) and node.op == "and":
        return condition(node.left, resolve) & condition(node.right, resolve)
    if isinstance(node, Binary) and node.op in _COMPARE:
        return _ordered(node.op, compile_expression(node.left, resolve), compile_expression(node.right, resolve))
    return truth(compile_expression(node, resolve))


__all__ = ["NULL", "compile_expression", "condition", "truth"]
