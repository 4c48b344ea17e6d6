"""Tokens of log lines: maximal runs of letters or of digits, camel case split.

A token ends where letters and digits change, where a lower-case letter meets an
upper-case one, and at anything that is neither. Everything is expressed as
regular expressions that the JVM evaluates; no line is tokenised in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter tokens are neither indexed nor searched.
MIN_TOKEN = 3

TOKEN = r"\p{Nd}+|\p{L}(?:(?<!\p{Ll})\p{L}|[\p{L}&&[^\p{Lu}]])*"
_TOKEN = regex.compile(r"\p{Nd}+|\p{L}(?:(?<!\p{Ll})\p{L}|[\p{L}--\p{Lu}])*", regex.V1)


@dataclass(frozen=True)
class Token:
    text: str
    at: int


def tokenize(text: str) -> list[Token]:
    return [Token(m[0], m.start()) for m in _TOKEN.finditer(text)]


def quote(text: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def bounded(token: str) -> str:
    """A Java regular expression for ``token`` where it is a whole token of a line."""
    first, last = token[0], token[-1]
    left = r"(?<!\p{Nd})" if first.isdecimal() else r"(?<![\p{L}&&[^\p{Ll}]])" if first.isupper() else r"(?<!\p{L})"
    right = r"(?!\p{Nd})" if last.isdecimal() else r"(?![\p{L}&&[^\p{Lu}]])" if last.islower() else r"(?!\p{L})"
    return left + quote(token) + right


def tokens_of(text: Column) -> Column:
    """Array of all tokens of a line."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def vocabulary(log: DataFrame, text: str = "message", least: int = MIN_TOKEN) -> DataFrame:
    """(token, lines, occurrences): distinct tokens with partial counts before the shuffle."""
    found = F.array_sort(F.filter(tokens_of(F.col(text)), lambda t: F.length(t) >= least))
    # Tokens are sorted: the first of each run of equals counts the line. Only a token and that mark leave the line.
    marked = F.transform(F.array(found), lambda a: F.transform(a, lambda t, k: F.struct(t.alias("token"), ((k == 0) | (t != F.get(a, k - 1))).alias("new"))))
    each = log.select(F.explode(F.element_at(marked, 1)).alias("t")).select("t.token", "t.new")
    return each.groupBy("token").agg(F.count_if(F.col("new")).alias("lines"), F.count(F.lit(1)).alias("occurrences"))


def estimate(log: DataFrame, phrase: str, text: str = "message") -> DataFrame:
    """One row, ``estimate``: the least number of occurrences of the phrase's tokens (0 if one is unknown, all lines if it has none)."""
    wanted = sorted({t.text for t in tokenize(phrase) if len(t.text) >= MIN_TOKEN})
    if not wanted:
        return log.agg(F.count(F.lit(1)).alias("estimate"))
    found = tokens_of(F.col(text))
    sums = [
        F.coalesce(F.sum(F.size(F.array_remove(F.transform(F.col("ts"), _same(t)), False)).cast("long")), F.lit(0).cast("long")) for t in wanted
    ]
    return log.select(found.alias("ts")).agg((F.least(*sums) if len(sums) > 1 else sums[0]).alias("estimate"))


def _same(token: str):
    return lambda x: x == F.lit(token)
