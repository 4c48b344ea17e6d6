import codecs
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import charts, index, tokens
from lumenlog.plans import engine
from lumenlog.plans.engine import Indexer, Log, context
from lumenlog.sources import files, shared
from lumenlog.sources.catalog import Catalog, SavedQuery
from lumenlog.sources.sinks import row_text, write_csv, write_text
from lumenlog.streaming import logs as streaming


@pytest.mark.parametrize("raw, lines", [
    ("a\nb", ["a", "b"]), ("a\rb\r", ["a", "b"]), ("a\r\nb\r\n", ["a", "b"]), ("a\n\rb", ["a", "b"]), ("", []), ("\n", [""]), ("\n\n", ["", ""]), ("a\n\nb", ["a", "", "b"]), ("x" * 1200 + "\ny", ["x" * 1200, "y"]),
])
def test_line_breaks(raw, lines):
    got = list(files.split_lines(raw.encode()))
    assert [x for _, x in got] == lines
    for at, line in got:
        assert raw.encode()[at:].startswith(line.encode())


@pytest.mark.parametrize("mark, name", [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF32_BE, "utf-32-be"), (b"", "utf-8")])
def test_encodings(mark, name):
    raw = mark + "é1\r\n日𝒳\nend".encode(name)
    got = list(files.split_lines(raw))
    assert [x for _, x in got] == ["é1", "日𝒳", "end"]
    for at, line in got:
        assert raw[at:].startswith(line.encode(name))


def test_file_order():
    assert sorted(files.ranked(["log.1", "log.2", "log.10", "a.zip", "b2.zip", "b1.zip", ""]).items(), key=lambda x: x[1]) == [
        ("", 0), ("a.zip", 1), ("b1.zip", 2), ("b2.zip", 3), ("log.10", 4), ("log.2", 5), ("log.1", 6),
    ]


def test_more_numbers_come_after_fewer():
    names = ["log.5", "log.1.2", "log", "log.10"]
    assert sorted(names, key=files.ranked(names).get) == ["log.1.2", "log.10", "log.5", "log"]


def test_context_keeps_the_logs_columns(spark):
    log = Log.from_table(spark.range(8).selectExpr("id AS index", "id * 100 AS hit", "'x' AS t"), "t", "index")
    with pytest.raises(ValueError):
        context(log, F.col("index") == 1)
    got = context(log, F.col("index") == 1, pad=True, names=("a", "b", "c")).orderBy("b").collect()
    assert [r["c"] for r in got] == [None] * 4 + list(range(7)) and [r["hit"] for r in got][4:] == [100 * k for k in range(7)]


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(engine, "DEEP", 3)
    r = Log.from_table(spark.range(50).selectExpr("id", "id % 7 AS v", "'x' AS t"), "t", "id").query("* select id, v order by v")
    every = [tuple(x) for x in r.ordered().collect()]
    assert [tuple(x) for x in r.page(10, 5).collect()] == every[10:15]
    with pytest.raises(ValueError):
        r.numbered("v")


def test_shared_folder(spark, tmp_path):
    class Far:
        master, applicationId = "spark://far:7077", "x"

    class Session:
        sparkContext = Far

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        shared.top(Session)
    name = shared.folder(spark, "probe")
    spark.range(3).write.parquet(name)
    assert name.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.read.parquet(name).count() == 3
    shared.remove(spark, name)
    with pytest.raises(Exception):
        spark.read.parquet(name)


def test_index_order_and_refresh(spark, tmp_path):
    log = Log.from_table(spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma alpha"), (3, "beta beta alpha")], "id long, t string"), "t", "id")
    index.write(log, str(tmp_path / "ix"))
    ix = spark.read.parquet(str(tmp_path / "ix"))
    ids = lambda tokens, **k: sorted(r["id"] for r in index.search(ix, tokens, ("id",), **k).collect())
    assert ids(["alpha"]) == [1, 2, 3] and ids(["alpha", "gamma"]) == [1] and ids(["gamma", "alpha"]) == [2] and ids(["beta", "zzz"]) == []
    assert ids(index.phrase_tokens("beta gamma"), exact=True) == [1] and ids(index.phrase_tokens("alpha gamma"), exact=True) == []
    assert index.matching(ix, log, []).df.count() == 3
    with pytest.raises(ValueError):
        index.write(log, str(tmp_path / "ix"), "append")


def test_indexer_is_told_of_failure(spark):
    class Bad(Indexer):
        def update(self, log):
            return log.df

        def complete(self, error):
            self.error = error

    bad, log = Bad(), Log.from_table(spark.range(1).selectExpr("id", "'x' AS t"), "t", "id")

    def sink(name, df):
        raise OSError(name)

    with pytest.raises(OSError):
        log.index_with({"bad": bad}, sink)
    assert isinstance(bad.error, OSError)


def test_reading(spark, tmp_path):
    (tmp_path / "app.log.2").write_bytes(b"old one\nold two\n")
    (tmp_path / "app.log.1").write_bytes(b"new one\r\nnew two")
    with zipfile.ZipFile(tmp_path / "app.zip", "w") as z:
        z.writestr("m1.log", "zipped one\n")
        z.writestr("m2.log", "zipped two\n")
    log = files.read_log(spark, str(tmp_path / "app"))
    got = [(r["member"], r["position"], r["line"], r["message"]) for r in log.read().collect()]
    assert [g[3] for g in got] == ["zipped two", "zipped one", "old one", "old two", "new one", "new two"]
    assert got[5][1:3] == (9, 2)
    assert [r[0] for r in log.query('"one" limit 2').df.collect()] == ["zipped one", "old one"]
    assert files.read_log(spark, str(tmp_path / "nothing")).df.count() == 0
    assert files.read_log(spark, str(tmp_path)).df.count() == 6
    split = files.read_splits(spark, str(tmp_path / "app.log.*"))
    assert [r["message"] for r in split.read().collect()] == ["old one", "old two", "new one", "new two"]
    before = files.find(spark, [str(tmp_path)])
    (tmp_path / "app.log.1").unlink()
    (tmp_path / "app.log.2").write_bytes(b"changed")
    now, gone, again = streaming.refresh(spark, [str(tmp_path)], before)
    assert len(now) == 2 and gone[0].endswith("app.log.1") and again[0].endswith("app.log.2")


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 'a;b' AS x, timestamp'2020-01-02 03:04:05.678' AS t, cast(null AS double) AS v")
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).collect()[0]["x"] == "a;b"
    write_text(df, str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).collect()[0][0] == row_text(df).collect()[0][0] == "a;b\t2020-01-02 03:04:05,678\t"


def test_catalog(tmp_path):
    shared = Catalog(tmp_path / "shared.xml")
    shared.save(SavedQuery("b", "*"))
    shared.save(SavedQuery("a", '"x"'))
    own = Catalog(tmp_path / "own.xml", tmp_path / "shared.xml")
    own.save(SavedQuery("b", '"<&>"', "pie"))
    assert [(q.title, q.query) for q in own.all()] == [("a", '"x"'), ("b", '"<&>"')]
    own.remove("b")
    assert own.get("b").query == "*" and own.get("z") is None


def test_charts_context_and_index(spark, tmp_path):
    log = Log.from_table(spark.range(30).select("id", F.concat(F.lit("line number "), F.col("id").cast("string")).alias("t")), "t", "id")
    near = context(log, F.col("id") == 2)
    assert sorted(r["index"] for r in near.collect()) == list(range(8))
    r = log.query("* group by id as k select sum(id) as s order by s desc")
    got = {x["category"]: x["amount"] for x in charts.categories(r, "k", "s").collect()}
    assert got["29.0"] == 29 and got["Other"] == sum(range(20)) and len(got) == 11
    assert abs(sum(x["share"] for x in charts.shares(r.df, "k", "s").collect()) - 1) < 1e-9
    assert charts.limits(r.df, "k", "s").collect()[0][:] == (0.0, 29.0)
    with pytest.raises(ValueError):
        charts.check("pie", r.df, "k")
    index.write(log, str(tmp_path / "ix"))
    assert index.candidates(spark, str(tmp_path / "ix"), log, "line number").df.count() == 30
    assert index.candidates(spark, str(tmp_path / "ix"), log, "missing").df.count() == 0
    assert {x["token"]: (x["lines"], x["occurrences"]) for x in tokens.vocabulary(log.df).collect()} == {"line": (30, 30), "number": (30, 30)}
    assert tokens.estimate(log.df, "line zzz").collect()[0][0] == 0


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("INFO x = 1\nWARN x = 5\nnoise\n")
    stream = streaming.lines(spark, str(tmp_path / "in"))
    flat = streaming.start(streaming.transform(stream, '"{level} x = {x:number}" where x > 2 select level, x'), "flat", checkpoint=str(tmp_path / "c1"))
    grouped = streaming.start(streaming.transform(stream, '"{level} x = {x:number}" group by level select count(*) as n, sum(x) as s'), "grouped", "complete", str(tmp_path / "c2"))
    flat.processAllAvailable()
    grouped.processAllAvailable()
    (tmp_path / "in" / "b.log").write_text("WARN x = 7\n")
    flat.processAllAvailable()
    grouped.processAllAvailable()
    flat.stop()
    grouped.stop()
    assert sorted(tuple(r) for r in spark.table("flat").collect()) == [("WARN", 5.0), ("WARN", 7.0)]
    assert sorted(tuple(r) for r in spark.table("grouped").collect()) == [("INFO", 1, 1.0), ("WARN", 2, 12.0)]
    with pytest.raises(ValueError):
        streaming.transform(stream, "* select last(x)")
