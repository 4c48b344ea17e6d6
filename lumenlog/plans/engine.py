"""Queries over logs: a log is a DataFrame with a total order, a query compiles to another DataFrame.

Nothing runs until the result is used, save one aggregation that ``parse`` needs to
learn its columns. Log order is carried in key columns and only sorted by where it
shows: in ``order by`` ties, ``limit``, paging and context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions.expressions import compile_expression, condition
from lumenlog.functions.values import NULL, NUMBER, Value, from_field
from lumenlog.operators import aggregates, parsers
from lumenlog.operators.match import RAW, compile_match
from lumenlog.plans.syntax import Aggregate, Item, Query, describe, parse
from lumenlog.sources.shared import folder

PAGE = 1024
#: Pages that end beyond this place are found by ranges.
DEEP = 100_000


class Indexer:
    """What a plugin that indexes lines does; subclasses override what they need."""

    def initialize(self, columns: list[str]) -> None:
        """Before any line is seen."""

    def update(self, log: Log) -> DataFrame:
        """The indexer's rows for the lines of a log."""
        raise NotImplementedError

    def complete(self, error: Exception | None) -> None:
        """After the rows were taken, or could not be."""


@dataclass(frozen=True)
class Log:
    """Lines (``message``) with key columns that order them and fields that queries can name."""

    df: DataFrame
    order: tuple[str, ...]
    message: str = "message"
    #: Whether lines are made from other columns, so that they are worth keeping once made.
    rendered: bool = False

    @staticmethod
    def from_table(df: DataFrame, text: str | Column, order_by: str | list[str]) -> Log:
        """Any DataFrame as a log: ``text`` is the line, the other columns are fields."""
        order = (order_by,) if isinstance(order_by, str) else tuple(order_by)
        column = F.col(text) if isinstance(text, str) else text
        return Log(df.withColumn("message", column.cast("string")), order, rendered=not isinstance(text, str))

    def query(self, text: str | None) -> Result:
        return Result(self, parse(text))

    def at(self, rows: DataFrame) -> Log:
        """The lines whose key columns are among those of ``rows``."""
        return Log(self.df.join(rows.select(*self.order).distinct(), list(self.order), "left_semi"), self.order, self.message, self.rendered)

    def index_with(self, indexers: dict[str, Callable[[Log], DataFrame] | Indexer], sink: Callable[[str, DataFrame], None] | None = None) -> dict[str, DataFrame]:
        """What each indexer makes of the log's lines, lazily.

        An ``Indexer`` is told to initialize with the log's columns first, makes its rows in ``update``,
        and is told to complete, or to fail, when ``sink`` has taken its rows; without a sink, at once.
        """
        out = {}
        for name, f in indexers.items():
            if not isinstance(f, Indexer):
                out[name] = f(self)
            else:
                f.initialize(self.df.columns)
                out[name] = f.update(self)
            try:
                if sink is not None:
                    sink(name, out[name])
            except Exception as error:
                if isinstance(f, Indexer):
                    f.complete(error)
                raise
            if isinstance(f, Indexer):
                f.complete(None)
        return out

    def read(self) -> DataFrame:
        """All lines in log order."""
        return self.df.orderBy(*self.order)


@dataclass
class _State:
    df: DataFrame
    order: list[str]
    fields: dict[str, Value]
    shown: list[str]
    sort: list[Column] = field(default_factory=list)

    def resolve(self, name: str) -> Value:
        return self.fields.get(name, Value(F.lit(None), NULL))

    def key(self) -> Column:
        return F.struct(*[F.col(f"`{o}`") for o in self.order])


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is evaluated once per row: filters on it aren't pushed below its making."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _distinct_names(items: list[Item]) -> None:
    names = [i.name for i in items]
    for n in names:
        if names.count(n) > 1:
            raise QueryError(f"two columns are named {n!r}")


class Result:
    """A compiled query: its DataFrame, columns, pages and plan."""

    def __init__(self, log: Log, query: Query):
        self.log, self.query = log, query
        self._state = self._compile()

    # ------------------------------------------------------------ stages

    def _search(self) -> _State:
        log = self.log
        raws: list[Column] = []
        m = compile_match(self.query.search, F.col(f"`{log.message}`"), raws=raws)
        df = log.df
        if m.condition is not None:
            df = (_once(df, F.col(f"`{log.message}`"), log.message) if log.rendered else df).filter(m.condition)
        if raws:
            df = _once(df, F.struct(*raws), RAW)
        for test in m.late:
            df = df.filter(test)
        order = {f"__o{n}": F.col(f"`{c}`") for n, c in enumerate(log.order)}
        columns, fields = [], {}
        for n, f in enumerate(log.df.schema.fields):  # RAW isn't among them
            columns.append(F.col(f"`{f.name}`").alias(f"c{n}"))
            fields[f.name] = from_field(F.col(f"c{n}"), f.dataType)
        fields["message"] = fields.pop(log.message)
        for n, (name, v) in enumerate(m.fields.items()):
            columns.append(v.col.alias(f"m{n}"))
            fields[name] = Value(F.col(f"m{n}"), v.kind)
        df = df.select(*[c.alias(o) for o, c in order.items()], *columns)
        return _State(df, list(order), fields, ["message", *(n for n in m.fields if n != "message")])

    def _parse(self, s: _State) -> _State:
        stage = self.query.parse
        source = s.resolve(stage.column)
        text = source.col.cast("string")
        p = parsers.get(stage.parser)(s.df, text, s.key())
        fields: dict[str, Value] = {}
        columns = []
        for n, (name, v) in enumerate(p.fields.items()):
            old = s.fields.get(name)
            kept = old.col if old is not None and not p.all_good and old.kind == v.kind else None
            col = v.col if p.all_good else F.when(p.good, v.col) if kept is None else F.when(p.good, v.col).otherwise(kept)
            columns.append(col.alias(f"p{n}"))
            fields[name] = Value(F.col(f"p{n}"), v.kind)
        shown = list(fields)
        if not p.all_good:
            for n, (name, v) in enumerate(s.fields.items()):
                if name not in fields:
                    columns.append(F.when(~p.good, v.col).alias(f"q{n}"))
                    fields[name] = Value(F.col(f"q{n}"), v.kind)
            shown = [n for n in s.shown if n not in shown] + shown
        return _State(s.df.select(*s.order, *columns), s.order, fields, shown)

    def _compile(self) -> _State:
        q = self.query
        s = self._search()
        if q.parse:
            s = self._parse(s)
        if q.where is not None:
            s.df = s.df.filter(condition(q.where, s.resolve))
        named = any(isinstance(i.value, Aggregate) for i in q.select or [])
        if q.group:
            keys = [compile_expression(i.value, s.resolve) for i in q.group]
            _distinct_names([*q.group, *(q.select or [])])
            df, values = aggregates.grouped(s.df, keys, q.select or [], s.resolve, s.key())
            names = [i.name for i in [*q.group, *(q.select or [])]]
            s = _State(df, ["__first"], dict(zip(names, values)), names)
        elif named:
            _distinct_names(q.select)
            df, values = aggregates.overall(s.df, q.select, s.resolve, s.key())
            names = [i.name for i in q.select]
            s = _State(df, ["__first"], dict(zip(names, values)), names)
        elif q.select:
            _distinct_names(q.select)
            values = [compile_expression(i.value, s.resolve) for i in q.select]
            df = s.df.select(*s.order, *[(v.col.cast("string") if v.kind == NULL else v.col).alias(f"s{n}") for n, v in enumerate(values)])
            names = [i.name for i in q.select]
            s = _State(df, s.order, {name: Value(F.col(f"s{n}"), v.kind) for n, (name, v) in enumerate(zip(names, values))}, names)
        if q.order:
            for o in q.order:
                v = s.resolve(o.column)
                if v.kind != NULL:
                    s.sort += _sort_keys(v, o.descending)
        if q.limit is not None:
            s.df = s.df.orderBy(*s.sort, *s.order).limit(q.limit)
        return s

    # ------------------------------------------------------------ use

    @property
    def columns(self) -> dict[str, str]:
        """Names and kinds of the result's columns."""
        return {n: self._state.fields[n].kind for n in self._state.shown}

    def describe(self, time_format: str = "yyyy-MM-dd HH:mm:ss,SSS") -> list[tuple[str, str, str]]:
        """Header, kind and display format of each column."""
        return [(n, k, time_format if k == "time" else "") for n, k in self.columns.items()]

    def _shown(self) -> list[Column]:
        return [self._state.fields[n].col.alias(n) for n in self._state.shown]

    @property
    def df(self) -> DataFrame:
        """The rows; sorted only if the query says so."""
        s = self._state
        return (s.df.orderBy(*s.sort, *s.order) if s.sort else s.df).select(*self._shown())

    def ordered(self) -> DataFrame:
        """The rows in the query's order, ties in log order."""
        s = self._state
        return s.df.orderBy(*s.sort, *s.order).select(*self._shown())

    def page(self, start: int = 0, size: int = PAGE) -> DataFrame:
        """``size`` rows from place ``start`` on; pages beyond ``DEEP`` are cut from ranges, not from one task's top rows."""
        s = self._state
        if start + size > DEEP:
            rows = placed(s.df, self._keys(), "__place").filter((F.col("__place") >= start) & (F.col("__place") < start + size))
            return rows.orderBy("__place").select(*self._shown())
        return s.df.orderBy(*s.sort, *s.order).offset(start).limit(size).select(*self._shown())

    def _keys(self) -> list[Column]:
        return [*self._state.sort, *[F.col(f"`{o}`").asc() for o in self._state.order]]

    def numbered(self, name: str = "index") -> DataFrame:
        """The rows with their places in the result, from 0."""
        s = self._state
        if name in s.shown:
            raise QueryError(f"two columns are named {name!r}")
        return placed(s.df, self._keys(), "__place").select(F.col("__place").alias(name), *self._shown())

    def count(self) -> int:
        return self._state.df.count()

    def plan(self) -> str:
        """The query as indented text."""
        return describe(self.query)


def _sort_keys(v: Value, descending: bool) -> list[Column]:
    """Nulls below all values and NaN below all numbers."""
    keys = [v.col.isNotNull()]
    if v.kind == NUMBER:
        keys.append(~F.isnan(v.col.cast("double")))
    return [k.desc() if descending else k.asc() for k in [*keys, v.col]]


def placed(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in the order of ``keys``, without sorting all rows in one task.

    Rows are sorted within ranges; a range starts at the number of rows in those before it. Ranges are
    drawn by sampling, so they are written once to the shared folder and read by both sides.
    """
    spark = df.sparkSession
    p, n, c, at = (f"__placed_{x}" for x in ("range", "row", "size", "start"))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(p, F.spark_partition_id())
    ranged = ranged.withColumn(n, F.monotonically_increasing_id() - F.shiftleft(F.col(p).cast("bigint"), 33))
    path = folder(spark, "placed")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy(p).agg(F.count(F.lit(1)).alias(c))
    # One row per range, and at most as many as there are shuffle partitions: small by its making.
    before = F.sum(c).over(W.orderBy(p).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(p, F.coalesce(before, F.lit(0)).alias(at))
    return ranged.join(F.broadcast(starts), p).withColumn(name, F.col(at) + F.col(n)).drop(p, n, at)


def context(log: Log, at: Column, around: int = 5, pad: bool = False, names: tuple[str, str, str] = ("hit", "distance", "index")) -> DataFrame:
    """Lines at most ``around`` places from each line that satisfies ``at``: ``names`` (the hit's place, the distance, the line's place) and the line.

    With ``pad``, places before the log's first line are rows too, without a place and a line. ``names`` must not be
    columns of the log. Only places that hits ask for are joined, so work grows with the hits, not with pairs of lines.
    """
    if clash := set(names) & set(log.df.columns):
        raise QueryError(f"the log has columns named {sorted(clash)}; give other names")
    rows = placed(log.df.withColumn("__context_hit", F.coalesce(at, F.lit(False))), [F.col(f"`{o}`").asc() for o in log.order], "__context_at")
    hits = rows.filter("__context_hit").select(F.col("__context_at").alias("__hit_at"), F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("__hit_off"))
    near = hits.withColumn("__context_at", F.col("__hit_at") + F.col("__hit_off"))
    near = near.filter("__context_at >= 0") if not pad else near
    both = near.join(rows.withColumn("__context_on", F.lit(True)), "__context_at", "left" if pad else "inner")
    if pad:
        both = both.filter("__context_on OR __context_at < 0").withColumn("__context_at", F.expr("CASE WHEN __context_at >= 0 THEN __context_at END"))
    mine = [F.col(c).alias(f"`{n}`".strip("`")) for c, n in zip(("__hit_at", "__hit_off", "__context_at"), names)]
    return both.select(*mine, *[f"`{c}`" for c in log.df.columns])
