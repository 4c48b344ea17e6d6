"""Quality rules, line first: clean each line, then reject documents that lose too much.

Everything here is a DataFrame expression. A document is read once, no row is
shuffled, and no state outlives a row, so the operator scales with the scan.

Edge cases: a null or empty text has no words, fails the base rules and is
rejected; repeated rows are judged one by one; extra columns pass through
``apply``; any row's result depends on that row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import WORD, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that keeps a smaller share of its word characters is rejected.
MIN_KEPT_SHARE = 0.5

SYMBOLS = r"[#*$%&|<>]"
#: A line ends in one full stop, question or exclamation mark, ellipsis, colon-free quote or bracket.
ENDS_WELL = r"[.!?…。！？][\"'\)\]»”’]*[\x20\x09-\x0D]*$"
#: Prose of this many words may end without a mark, as where it was cut.
LONG = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){30}"
#: One word four times in a row.
STUTTER = r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1){3}(?:[\x20\x09-\x0D]|$)"
SHOUTS = r"[!?]{2,}[\"'\)\]»”’]*[\x20\x09-\x0D]*$"
#: Menus: two or more separators that stand between blanks, or a trail of arrows.
NAVIGATION = r"(?:(?:^|[\x20\x09])(?:\||»|>|/|•|·)(?:[\x20\x09].*[\x20\x09]|[\x20\x09])(?:\||»|>|/|•|·)(?:[\x20\x09]|$))|[\x20\x09]\|[\x20\x09]*$"
#: Three marks in a row, twice or more in a line.
MARKS = r"[#$%&*<>|]{3}.*[#$%&*<>|]{3}"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|"
    r"accept (?:all )?cookies|enable javascript|requires javascript|click here|sign up for our newsletter|"
    r"subscribe to our|lorem ipsum|skip to (?:main )?content|back to top)\b"
)


def _windows(ws: Column, n: Column) -> Column:
    """64-bit hashes of all 8-word windows by doubling: 1, 2, 4, then 8 words."""
    def doubled(step: int):
        return lambda x: F.zip_with(
            F.slice(x, F.lit(1), F.size(x) - step), F.slice(x, F.lit(1 + step), F.size(x) - step), lambda a, b: F.xxhash64(a, b)
        )

    h = F.transform(ws, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = let(h, doubled(step))
    return F.when(n >= WINDOW, h).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, each word once."""

    def by_sorting(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.zip_with(
                F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a["h"] == b["h"]
            )
            flags = let(same, lambda e: F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda a, b: a | b))
            marked = F.zip_with(s, flags, lambda x, f: F.when(f, x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def lengths(p: Column) -> Column:
            gaps = F.zip_with(
                F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long")
            )
            return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g)

        return let(let(pairs, positions), lengths)

    return let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(by_sorting(hs)))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word."""
    return ~(line.rlike(ENDS_WELL) | line.rlike(LONG)) | line.rlike(SHOUTS) | line.rlike(MARKS) | line.rlike(STUTTER) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def quality(docs: DataFrame, text: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """``docs`` with a struct column ``quality``: base figures, verdict and cleaned text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"), words(t).alias("ws"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("full"),
    )
    n = F.size("ws")
    step = step.select(
        "row", "full", "t",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _covered(_windows(F.col("ws"), n)).alias("n_repeat_words"),
        F.filter(F.split("t", "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)).alias("good"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept_chars = F.char_length(F.regexp_replace(F.array_join("good", "\n"), r"[\x20\x09-\x0D]+", "")).cast("long")
    step = step.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), kept_chars.alias("kept_chars"), F.array_join("good", "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (F.col("kept_chars") >= min_kept_share * F.col("word_chars"))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "clean_text"]
    return step.select("row", F.struct(*figures, kept.alias("kept")).alias("quality"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with the base figures and the verdict."""
    q = quality(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("row.doc_id", *[f"quality.{c}" for c in names])


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed; all columns of ``docs`` stay."""
    # A filter would be pushed down and compute the verdict, and all it rests on, a second time. The
    # partition's number, which is never negative, keeps it above: the optimiser moves no filter past it.
    keep = F.col("quality.kept") & (F.spark_partition_id() >= 0)
    q = quality(docs).select("row", "quality", keep.alias("keep")).filter("keep")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("quality.clean_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.char_length("quality.clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return q.select(*columns)


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS s FROM documents),
w AS (SELECT rid, doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws, string_split(s, chr(10)) AS ls FROM t),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g
      FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i) WHERE len(ws) >= 8),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest(generate_series(0, 7)) AS v(k) GROUP BY rid),
l AS (SELECT rid, k, x, lw, regexp_matches(x, '[^\x20\x09-\x0D]') AS has_word
      FROM w, unnest(generate_series(1, len(ls))) AS u(k), LATERAL (SELECT ls[k] AS x, regexp_extract_all(ls[k], '[^\x20\x09-\x0D]+') AS lw)),
m AS (SELECT rid,
        count(*) FILTER (has_word) - count(DISTINCT x) FILTER (has_word) AS n_dup_lines,
        coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (has_word
          AND (regexp_matches(x, '[.!?…。！？]["''\)\]»”’]*[\x20\x09-\x0D]*$') OR regexp_matches(x, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){30}'))
          AND NOT regexp_matches(x, '[!?]{2,}["''\)\]»”’]*[\x20\x09-\x0D]*$')
          AND NOT coalesce(list_bool_or(list_transform(range(1, len(lw) - 2), lambda i: lw[i] = lw[i + 1] AND lw[i] = lw[i + 2] AND lw[i] = lw[i + 3])), false)
          AND NOT regexp_matches(x, '[#$%&*<>|]{3}.*[#$%&*<>|]{3}')
          AND NOT regexp_matches(x, '(?:(?:^|[\x20\x09])(?:\||»|>|/|•|·)(?:[\x20\x09].*[\x20\x09]|[\x20\x09])(?:\||»|>|/|•|·)(?:[\x20\x09]|$))|[\x20\x09]\|[\x20\x09]*$')
          AND NOT regexp_matches(x, '(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|accept (?:all )?cookies|enable javascript|requires javascript|click here|sign up for our newsletter|subscribe to our|lorem ipsum|skip to (?:main )?content|back to top)\b')
        ), 0) AS kept_chars
      FROM l GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept
FROM (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed, coalesce(kept_chars, 0) AS kept_chars
      FROM w LEFT JOIN c USING (rid) LEFT JOIN m USING (rid))
"""
