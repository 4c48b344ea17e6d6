"""Log files as logs: plain files, folders, name prefixes and zip archives.

Two readers give the canonical columns (file, member, position, line, file_rank,
member_rank, message). ``read_log`` is exact: any line break, any Unicode mark at
the start, byte positions, archive members; a file is read by one task. For very
large plain files ``read_splits`` cuts files into splits, with positions that
order lines but don't count bytes.

Files come in the order of log rotation: archives first and ascending by the
numbers in their names, plain files descending.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.plans.engine import Log

ORDER = ("file_rank", "member_rank", "position")
SCHEMA = "file string, member string, position long, line int, file_rank int, member_rank int, message string"
BREAK = re.compile("\r\n|\n\r|\r|\n")
_ARROW = pa.schema([
    ("file", pa.string()), ("member", pa.string()), ("position", pa.int64()), ("line", pa.int32()), ("file_rank", pa.int32()), ("member_rank", pa.int32()), ("message", pa.string()),
])

# Byte order marks and the encodings they announce.
MARKS = (
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
    (b"+/v", "utf-7"),
)


def compare_names(a: str, b: str) -> int:
    """The order of two file names by kind and by the numbers in them."""
    if bool(a) != bool(b):
        return -1 if not a else 1
    zipped = a.lower().endswith(".zip"), b.lower().endswith(".zip")
    if zipped[0] != zipped[1]:
        return -1 if zipped[0] else 1
    sign = 1 if zipped[0] else -1
    x, y = ([int(n) for n in re.findall(r"\d+", s)] for s in (a, b))
    if not x and not y:
        return sign * ((a > b) - (a < b))
    # More numbers come after fewer, whatever their values.
    a, b = (len(x), x), (len(y), y)
    return sign * ((a > b) - (a < b))


def ranked(names: list[str]) -> dict[str, int]:
    return {n: k for k, n in enumerate(sorted(sorted(names), key=cmp_to_key(compare_names)))}


def encoding_of(head: bytes) -> tuple[str, int]:
    """The encoding that the first bytes announce, and how many of them do."""
    for mark, name in MARKS:
        if head.startswith(mark):
            # UTF-7's mark is text and shares its last byte with it.
            return name, 0 if name == "utf-7" else len(mark)
    return "utf-8", 0


def split_lines(raw: bytes) -> Iterator[tuple[int, str]]:
    """(byte position, line) of each line; what follows the last break counts if there is any."""
    name, at = encoding_of(raw[:4])
    text = raw[at:].decode(name, "replace")
    if name == "utf-7":
        text = text.lstrip("﻿")
    unit = {"utf-16-le": 2, "utf-16-be": 2, "utf-32-le": 4, "utf-32-be": 4}.get(name)

    def size(s: str) -> int:
        return len(s) * unit if unit == 4 else len(s.encode(name, "replace"))

    start = 0
    for m in BREAK.finditer(text):
        line = text[start : m.start()]
        yield at, line
        at += size(line) + (unit or 1) * len(m[0])
        start = m.end()
    if start < len(text):
        yield at, text[start:]


def members(path: str, raw: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(member, rank, bytes): the entries of a zip archive, or the file itself."""
    if not path.lower().endswith(".zip"):
        yield "", 0, raw
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        for name, rank in sorted(ranked(names).items(), key=lambda x: x[1]):
            yield name, rank, z.read(name)


def find(spark: SparkSession, sources: list[str]) -> list[tuple[str, object, int]]:
    """(path, modified, length) of the files that sources name: files, folders (not below) or prefixes (``dir/name*``).

    A source that names nothing gives nothing.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, tuple[str, object, int]] = {}
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(conf)
        glob = path if any(c in source for c in "*?[{") else None
        if glob is None and fs.exists(path):
            found = [fs.getFileStatus(path)] if fs.getFileStatus(path).isFile() else list(fs.listStatus(path))
        else:
            found = list(fs.globStatus(glob if glob is not None else jvm.org.apache.hadoop.fs.Path(source + "*")) or [])
        for f in found:
            if f.isFile():
                name = f.getPath().toString()
                out[name] = (name, f.getModificationTime(), f.getLen())
    return sorted(out.values())


def _empty(spark: SparkSession) -> Log:
    return Log(spark.createDataFrame([], SCHEMA), ORDER)


def read_log(spark: SparkSession, *sources: str) -> Log:
    """The lines of all files that ``sources`` name."""
    paths = [p for p, _, _ in find(spark, list(sources))]
    if not paths:
        return _empty(spark)
    rank = ranked([re.sub(r"^file:/+", "file:/", p) for p in paths])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for member, order, content in members(path, raw.as_py()):
                    rows: list[tuple] = []
                    for n, (at, line) in enumerate(split_lines(content), 1):
                        rows.append((path, member, at, n, rank[path], order, line))
                        if len(rows) == 8192:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    files = spark.read.format("binaryFile").load([_escaped(p) for p in paths]).select("path", "content")
    return Log(files.select(F.regexp_replace("path", r"^file:/+", "file:/").alias("path"), "content").mapInArrow(lines, SCHEMA), ORDER)


def _escaped(path: str) -> str:
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW.field(k).type) for k in range(len(_ARROW))], schema=_ARROW)


def read_splits(spark: SparkSession, *sources: str) -> Log:
    """The lines of plain UTF-8 files, read in splits by many tasks; ``position`` orders lines."""
    paths = [p for p, _, _ in find(spark, list(sources)) if not p.lower().endswith(".zip")]
    if not paths:
        return _empty(spark)
    rank = ranked(paths)
    table = spark.createDataFrame([(re.sub(r"^file:/+", "/", p), r) for p, r in rank.items()], "name string, file_rank int")
    lines = spark.read.text([_escaped(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("file"), F.lit("").alias("member"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("member_rank"), F.col("value").alias("message"),
    )
    named = lines.join(F.broadcast(table), F.regexp_replace("file", r"^file:/+", "/") == F.col("name"), "left").drop("name")
    return Log(named.withColumn("position", F.col("block")), ("file_rank", "member_rank", "block", "id"))


def changes(before: list[tuple[str, object, int]], now: list[tuple[str, object, int]]) -> tuple[list[str], list[str]]:
    """(files that went, files that are new or changed) between two listings."""
    old = {p: (m, n) for p, m, n in before}
    new = {p: (m, n) for p, m, n in now}
    return sorted(old.keys() - new.keys()), sorted(p for p, s in new.items() if old.get(p) != s)


def from_lines(df: DataFrame, text: str, order_by: str | list[str]) -> Log:
    """One log line per line of a text column: rows in ``order_by`` order, lines within them."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    pieces = F.split(F.col(text), "\r\n|\n\r|\r|\n")
    # A last piece without text follows the last break and is no line.
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(kept).alias("line", "message")).withColumn("line", F.col("line") + 1)
    return Log(rows, (*order, "line"))
