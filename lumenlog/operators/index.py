"""A stored token index: where tokens stand, to answer token searches and to spare scans.

Rows are (file part, bucket, token, order columns, positions of the token in the line),
stored below ``part`` (a hash of the file's name) and ``bucket`` (a hash of the token),
so that a search reads the buckets of its tokens only and a file's rows can be
replaced alone. A search starts at its rarest token, whose postings are few; the
postings of the others are joined to them in the order of their frequency, and
positions are checked pair by pair. ``LogIndex`` keeps an index up to date with a
set of sources.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.operators.pattern import compile_pattern
from lumenlog.operators.tokens import MIN_TOKEN, Token, tokenize
from lumenlog.plans.engine import Log
from lumenlog.sources.files import changes, find, read_log
from lumenlog.sources.shared import remove as delete

BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _part(file: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(file)), 16, "0"))


def build(log: Log) -> DataFrame:
    """(part, bucket, token, order columns, positions) of every token of at least MIN_TOKEN characters, one row per line.

    Positions are places among the line's pieces, which are its tokens and what stands between them. A log
    without a ``file`` column is one part.
    """
    order = [F.col(f"`{c}`") for c in log.order]
    part = _part(F.col("file") if "file" in log.df.columns else F.lit(""))
    pieces = F.regexp_extract_all(F.coalesce(F.col(f"`{log.message}`"), F.lit("")), F.lit(_PIECE), F.lit(0))
    each = log.df.select(part.alias("part"), *order, F.posexplode(pieces).alias("at", "token")).filter((F.length("token") >= MIN_TOKEN) & F.col("token").rlike(r"^[\p{L}\p{Nd}]"))
    rows = each.groupBy("part", "token", *log.order).agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return rows.select("part", _bucket(F.col("token")).alias("bucket"), "token", *log.order, "positions")


#: A token, or a run of characters that are in none.
_PIECE = r"\p{Nd}+|\p{L}(?:(?<!\p{Ll})\p{L}|[\p{L}&&[^\p{Lu}]])*|[^\p{L}\p{Nd}]+"


def write(log: Log, path: str, mode: str = "overwrite") -> None:
    """Store the index; ``append`` adds the lines of another log, which must not be in it already."""
    rows = build(log)
    if mode == "append":
        spark = log.df.sparkSession
        old = spark.read.parquet(path).groupBy("part").agg(F.max(F.struct(*log.order)).alias("top"))
        new = rows.groupBy("part").agg(F.min(F.struct(*log.order)).alias("low"))
        if not old.join(new, "part").filter("low <= top").isEmpty():
            raise QueryError("appended lines must come after a file's lines in the index")
    rows.repartition("part", "bucket").write.mode(mode).partitionBy("part", "bucket").parquet(path)


def remove(index: DataFrame, file: str) -> DataFrame:
    """The index without one file's lines."""
    return index.filter(F.col("part") != _part(F.lit(file)))


def postings(index: DataFrame, token: str) -> DataFrame:
    """The rows of one token; only its bucket is read."""
    return index.filter((F.col("bucket") == _bucket(F.lit(token))) & (F.col("token") == token))


def search(index: DataFrame, tokens: list[Token | str], order: tuple[str, ...], exact: bool = False) -> DataFrame:
    """The order columns of the lines that hold all tokens.

    Each token must stand somewhere right of one before it; with ``exact``, at the distance that the
    tokens' own places have. No tokens give an error here, as the index doesn't hold all lines.
    """
    wanted = [t if isinstance(t, Token) else Token(t, -1) for t in tokens]
    if not wanted:
        raise QueryError("no tokens: all lines match, which the log itself gives")
    names = sorted({t.text for t in wanted})
    mine = reduce(lambda a, b: a | b, [(F.col("bucket") == _bucket(F.lit(n))) & (F.col("token") == n) for n in names])
    found = {r["token"]: r["n"] for r in index.filter(mine).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < len(names):
        return index.select(*order).limit(0)
    rare = sorted(names, key=lambda n: (found[n], n))
    place = {n: f"p{k}" for k, n in enumerate(rare)}
    rows = None
    for n in rare:
        mine = postings(index, n).select(*order, F.col("positions").alias(place[n]))
        rows = mine if rows is None else rows.join(mine, list(order))
    for a, b in zip(wanted, wanted[1:]):
        x, y = F.col(place[a.text]), F.col(place[b.text])
        if exact:
            rows = rows.filter(F.arrays_overlap(F.transform(x, _moved(b.at - a.at)), y))
        else:
            rows = rows.filter(F.array_max(y) > F.array_min(x))
    return rows.select(*order)


def _moved(by: int):
    return lambda p: p + F.lit(by)


def matching(index: DataFrame, log: Log, tokens: list[Token | str], exact: bool = False) -> Log:
    """The lines that ``search`` finds; all lines if there are no tokens."""
    if not tokens:
        return log
    return Log(log.df.join(search(index, tokens, log.order, exact), list(log.order), "left_semi"), log.order, log.message, log.rendered)


def candidates(spark: SparkSession, path: str, log: Log, phrase: str) -> Log:
    """``log`` cut down to lines that hold all tokens of a phrase (all lines if it has none).

    With few lines found, their join is by their keys; files none of whose lines are found are not read
    where the log's ``file`` column prunes its scan.
    """
    needles = compile_pattern(phrase).needles
    if not needles:
        return log
    index = spark.read.parquet(path)
    rows = None
    for n in needles:
        mine = postings(index, n).select(*log.order)
        rows = mine if rows is None else rows.join(mine, list(log.order), "left_semi")
    return Log(log.df.join(rows, list(log.order), "left_semi"), log.order, log.message, log.rendered)


@dataclass
class LogIndex:
    """An index over sources that is brought up to date file by file."""

    spark: SparkSession
    path: str
    sources: list[str]
    listing: list[tuple[str, object, int]] = field(default_factory=list)

    def refresh(self) -> tuple[list[str], list[str]]:
        """(files that went, files that were read): replaces the rows of files that went, are new or changed."""
        now = find(self.spark, self.sources)
        gone, again = changes(self.listing, now)
        known = {p for p, _, _ in self.listing}
        for name in [*gone, *[p for p in again if p in known]]:
            part = self.spark.range(1).select(_part(F.lit(_named(name))).alias("p")).first()["p"]
            delete(self.spark, f"{self.path}/part={part}")
        if again:
            build(_named_lines(read_log(self.spark, *again))).repartition("part", "bucket").write.mode("append").partitionBy("part", "bucket").parquet(self.path)
        self.listing = now
        return gone, again

    def log(self) -> Log:
        return read_log(self.spark, *[p for p, _, _ in self.listing])

    def query(self, text: str, phrase: str = "") -> DataFrame:
        """A query run again over the sources as they are now; ``phrase``, if given, is looked up first."""
        self.refresh()
        log = self.log()
        if phrase:
            log = Log(candidates(self.spark, self.path, _named_lines(log), phrase).df, log.order)
        return log.query(text).df


def _named_lines(log: Log) -> Log:
    """The log with keys that other files' coming and going leaves alone."""
    return Log(log.df, ("file", "member", "position"))


def _named(path: str) -> str:
    """A file's name as logs have it."""
    return "file:/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


def phrase_tokens(phrase: str) -> list[Token]:
    """The searchable tokens of a phrase with their places among its pieces."""
    ordinals: dict[int, int] = {}
    found, at, n = tokenize(phrase), 0, 0
    for t in found:
        n += t.at > at
        ordinals[t.at] = n
        at, n = t.at + len(t.text), n + 1
    return [Token(t.text, ordinals[t.at]) for t in found if len(t.text) >= MIN_TOKEN]


__all__ = ["LogIndex", "build", "candidates", "matching", "phrase_tokens", "postings", "remove", "search", "write"]
