"""Aggregates, grouped and global.

Single-valued aggregates become one row per group in one partial-and-final
aggregation. ``most`` and ``least`` count values first, so a frequent value is
folded before the shuffle, and are joined to the rest by the keys. ``distinct``
and plain expressions give many values: groups join them by line feeds, a global
select deals them out as rows, shorter columns padded with nulls. A lone global
``distinct`` or list is made without gathering the values in one task; ``median``
keeps a count of each distinct value. ``register`` adds single-valued aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.expressions import Resolve, compile_expression
from lumenlog.functions.values import BOOL, NAN, NULL, NUMBER, STRING, Value, as_text, convert
from lumenlog.plans.syntax import AGGREGATES, Aggregate, Item

MANY = ("distinct", "list")

#: Registered aggregates: name -> function of the argument and the log key that gives a column and its kind.
REGISTERED: dict[str, Callable[[Value, Column], tuple[Column, str]]] = {}


def register(name: str, function: Callable[[Value, Column], tuple[Column, str]]) -> None:
    """Add a single-valued aggregate to the language: ``function(argument, key)`` -> (aggregate column, kind)."""
    if name in AGGREGATES and name not in REGISTERED:
        raise QueryError(f"{name!r} is an aggregate of the language")
    REGISTERED[name] = function
    AGGREGATES.add(name)


def _name(item: Item) -> str:
    return item.value.name if isinstance(item.value, Aggregate) else "list"


def _argument(item: Item, resolve: Resolve) -> Value | None:
    node = item.value.arg if isinstance(item.value, Aggregate) else item.value
    return None if node is None else compile_expression(node, resolve)


def _plain(v: Value) -> Value:
    return Value(v.col.cast("string"), STRING) if v.kind == NULL else v


def single(name: str, v: Value | None, key: Column) -> tuple[Column, str]:
    """The column and kind of a single-valued aggregate."""
    if name == "count":
        if v is None:
            return F.count(F.lit(1)), NUMBER
        return (F.count_if(v.col) if v.kind == BOOL else F.count(v.col)), NUMBER
    if v is None:
        v = Value(F.lit(1.0), NUMBER)
    if name in REGISTERED:
        return REGISTERED[name](v, key)
    if name in ("first", "last"):
        v = _plain(v)
        pick = F.min_by if name == "first" else F.max_by
        return pick(v.col, F.when(v.col.isNotNull(), key)), v.kind
    x = convert(v, NUMBER).col
    if name == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0)), NUMBER
    if name == "mean":
        return F.coalesce(F.avg(x), F.lit(NAN)), NUMBER
    return {"median": F.median, "min": F.min, "max": F.max}[name](x), NUMBER


def _many(name: str, v: Value, key: Column) -> Column:
    """All values as an array: distinct ones in their own order, others in the log's."""
    v = _plain(v)
    if name == "distinct":
        return F.array_sort(F.collect_set(v.col))
    pairs = F.sort_array(F.collect_list(F.when(v.col.isNotNull(), F.struct(key.alias("k"), v.col.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _joined(values: Column, kind: str) -> Column:
    """One value as it is, several joined by line feeds, none as null; always text."""
    text = F.transform(values, lambda x: as_text(Value(x, kind)))
    return F.when(F.size(values) > 0, F.array_join(text, "\n"))


def _frequent(df: DataFrame, wanted: list[tuple[str, str]], v: Value, keys: list[str]) -> DataFrame:
    """``__first`` and the most or least frequent values (name, out) of each group; of equally frequent ones the least."""
    v = _plain(v)
    counts = df.groupBy(*[F.col(k) for k in keys], v.col.alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__f"))
    aggs = []
    for name, out in wanted:
        rank = F.col("__n") if name == "least" else -F.col("__n")
        aggs.append(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.struct(rank, F.col("__v")))).alias(out))
    return counts.groupBy(*keys).agg(F.min("__f").alias("__first"), *aggs)


def _with_frequent(base: DataFrame | None, df: DataFrame, frequent: list[tuple[str, str, Value, object]], keys: list[str]) -> DataFrame:
    """``base`` with the frequent values, one pass for each argument; without a base the first of them is it."""
    by: list[tuple[object, Value, list[tuple[str, str]]]] = []
    for out, name, v, node in frequent:
        same = next((b for b in by if b[0] == node), None)
        if same is None:
            by.append((node, v, [(name, out)]))
        else:
            same[2].append((name, out))
    for _, v, wanted in by:
        other = _frequent(df, wanted, v, keys)
        if base is None:
            base = other
            continue
        other = other.select(*[F.col(k).alias(f"{k}_") for k in keys], *[out for _, out in wanted])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        base = base.join(other, same, "left").drop(*[f"{k}_" for k in keys])
    return base


def grouped(df: DataFrame, keys: list[Value], items: list[Item], resolve: Resolve, key: Column) -> tuple[DataFrame, list[Value]]:
    """Rows of keys and aggregates with a column ``__first``, the least log key of each group."""
    names = [f"k{n}" for n in range(len(keys))]
    keys = [_plain(k) for k in keys]
    frame = df.withColumns({n: k.col for n, k in zip(names, keys)} | {"__key": key})
    aggs: list[Column] = [F.min("__key").alias("__first")]
    frequent, values = [], [Value(F.col(n), k.kind) for n, k in zip(names, keys)]
    for n, item in enumerate(items):
        name, v, out = _name(item), _argument(item, resolve), f"a{n}"
        if name in ("most", "least"):
            frequent.append((out, name, v, item.value.arg))
            values.append(Value(F.col(out), _plain(v).kind))
        elif name in MANY:
            aggs.append(_joined(_many(name, v, F.col("__key")), _plain(v).kind).alias(out))
            values.append(Value(F.col(out), STRING))
        else:
            col, kind = single(name, v, F.col("__key"))
            aggs.append(col.alias(out))
            values.append(Value(F.col(out), kind))
    base = frame.groupBy(*names).agg(*aggs) if len(aggs) > 1 or not frequent else None
    return _with_frequent(base, frame, frequent, names), values


def _alone(frame: DataFrame, name: str, v: Value) -> tuple[DataFrame, list[Value]]:
    """A global select of one list or ``distinct``: no task holds all values."""
    rows = frame.filter(v.col.isNotNull()).select(F.col("__key").alias("__first"), v.col.alias("a0"))
    if name == "distinct":
        rows = rows.select("a0").distinct().withColumn("__first", F.col("a0"))
    return rows, [Value(F.col("a0"), v.kind)]


def overall(df: DataFrame, items: list[Item], resolve: Resolve, key: Column) -> tuple[DataFrame, list[Value]]:
    """The rows of a global select with a column ``__first`` that numbers them."""
    frame = df.withColumns({"__one": F.lit(1), "__key": key})
    if len(items) == 1 and _name(items[0]) in MANY:
        return _alone(frame, _name(items[0]), _plain(_argument(items[0], resolve)))
    aggs, frequent, shapes = [], [], []
    for n, item in enumerate(items):
        name, v, out = _name(item), _argument(item, resolve), f"a{n}"
        if name in ("most", "least"):
            frequent.append((out, name, v, item.value.arg))
            shapes.append((out, _plain(v).kind, False))
        elif name in MANY:
            aggs.append(_many(name, v, F.col("__key")).alias(out))
            shapes.append((out, _plain(v).kind, True))
        else:
            col, kind = single(name, v, F.col("__key"))
            aggs.append(col.alias(out))
            shapes.append((out, kind, False))
    base = frame.agg(*aggs).withColumn("__one", F.lit(1)) if aggs else _row(frame)
    base = _with_frequent(base, frame, frequent, ["__one"])
    if any(many for _, _, many in shapes):
        # Named columns first, so that the zipped struct takes their names.
        arrays = base.select(*[(F.col(o) if many else F.array(F.col(o))).alias(o) for o, _, many in shapes])
        rows = arrays.select(F.posexplode(F.arrays_zip(*[F.col(o) for o, _, _ in shapes])).alias("__first", "__row"))
        base = rows.select("__first", *[F.col(f"__row.{o}").alias(o) for o, _, _ in shapes])
    else:
        base = base.withColumn("__first", F.lit(0))
    return base, [Value(F.col(o), kind) for o, kind, _ in shapes]


def _row(df: DataFrame) -> DataFrame:
    """One row, to which frequent values are joined even if there are none."""
    return df.sparkSession.range(1).select(F.lit(1).alias("__one"))


__all__ = ["grouped", "overall", "register", "single"]
