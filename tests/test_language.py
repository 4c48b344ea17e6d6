import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lumenlog import Log, QueryError
from lumenlog.plans.syntax import Aggregate, Binary, Combined, Literal, Phrase, Scan, parse

LINES = [
    "2020-01-01 00:00:00,000 [1] INFO countdown started",
    "2020-01-01 00:00:01,500 [2] WARN count = 5",
    "2020-01-01 00:00:02,000 [1] INFO count = abc",
    "2020-01-01 00:00:03,000 [3] ERROR count = 7.5",
    "",
    None,
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(n, x, float(n) if n != 2 else None, float("nan") if n == 3 else 1.0) for n, x in enumerate(LINES)]
    return Log.from_table(spark.createDataFrame(rows, "n long, text string, v double, w double"), "text", "n")


def rows(log, text):
    return [tuple(r) for r in log.query(text).ordered().collect()]


def test_grammar():
    assert parse("") == parse(None) and parse("").search == Scan()
    assert parse("just text").search == Phrase("just text")
    q = parse('"a" or "b" and not "c" where x > 1 and y == 2 ^ 2 ^ 3 group by a.b as "K" select count(*), min(a, 2) as m order by K desc, m limit 5')
    assert isinstance(q.search, Combined) and q.search.op == "or" and q.limit == 5
    assert q.where.op == "and" and q.where.right.right == Binary("^", Binary("^", Literal(2.0), Literal(2.0)), Literal(3.0))
    assert q.select[0].value == Aggregate("count", None) and q.select[0].name == "count(*)" and q.select[1].name == "m"
    assert [(o.column, o.descending) for o in q.order] == [("K", True), ("m", False)]


@pytest.mark.parametrize("bad", ['"a', '"a" where', '"a" limit x', '"a" and', '* select sum(a, b)', '* nonsense', '* select nofunction(1)', '* parse xml', '"{a:bogus!}"', '* select a as x, b as x'])
def test_errors(log, bad):
    with pytest.raises(QueryError):
        log.query(bad).df.collect()


def test_search_is_by_token(log):
    assert [r[0][24:] for r in rows(log, '"count"')] == ["[2] WARN count = 5", "[1] INFO count = abc", "[3] ERROR count = 7.5"]
    assert len(rows(log, 'not "count"')) == 3
    assert len(rows(log, '"INFO" xor "count"')) == 3
    assert len(rows(log, '"- -"')) == 0 and len(rows(log, "*")) == 6


def test_captures(log):
    assert rows(log, '"count = {x}" select x') == [("5",), ("abc",), ("7.5",)]
    assert rows(log, '"count = {x:number}" select x') == [(5.0,), (7.5,)]
    assert rows(log, '"{t:time} [{id}]" select t, id limit 1') == [(dt.datetime(2020, 1, 1), "1")]
    assert rows(log, '"{t:yyyy-MM} [{id}]" where t < time("0001-01-02", "yyyy-MM-dd") select id limit 1') == [("1",)]
    assert rows(log, '"WARN":k="w" or "ERROR":k="e" select k') == [("w",), ("e",)]
    assert list(log.query('"count = {x}"').columns) == ["message", "x"]


def test_null_and_nan_rules(log):
    assert rows(log, "* where v == nothing select n") == [(2.0,)]
    assert rows(log, "* where w == w select n") == [(0.0,), (1.0,), (2.0,), (4.0,), (5.0,)]
    assert rows(log, "* where v > 3 select n") == [(4.0,), (5.0,)]
    assert rows(log, "* where v != 3 select n") == [(0.0,), (1.0,), (2.0,), (4.0,), (5.0,)]
    got = rows(log, "* where n == 0 select 1/0, -1/0, 0/0, 5 % 0, sqrt(-1), log(0), log(-1), abs(nothing), round(2.5), bin(7.5, 5), bin(1, 0), trunc(-2.7), pow(nothing, 1), min(nothing, nothing)")[0]
    expect = [math.inf, -math.inf, math.nan, math.nan, math.nan, -math.inf, math.nan, math.nan, 2.0, 10.0, math.nan, -2.0, math.nan, math.nan]
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, expect)), got


def test_times(log):
    got = rows(log, '* where n == 0 select bin(time("2017-10-22 21:55:44,100"), "00:10") as a, time("x") as b, bin(duration("1.05:00:00"), "1") as c, duration("25:00") as d, bin(time("1960-01-01","yyyy-MM-dd"), "7") as e')[0]
    assert got[0] == dt.datetime(2017, 10, 22, 21, 50) and got[1] == dt.datetime(1, 1, 1) and got[2] == dt.timedelta(days=1) and got[3] == dt.timedelta(0)
    assert got[4] == dt.datetime(1, 1, 1) + (dt.datetime(1960, 1, 1) - dt.datetime(1, 1, 1)) // dt.timedelta(days=7) * dt.timedelta(days=7)


def test_aggregates(log):
    assert rows(log, "* select count(*) as n, count(v) as v, sum(v) as s, first(v) as f, last(v) as l, median(v) as m") == [(6, 5, 13.0, 0.0, 5.0, 3.0)]
    assert rows(log, "* select most(w) as m, least(v) as l") [0][1] == 0.0
    assert rows(log, '"count = {x}" select count(x) as n, x') == [(3, "5"), (None, "abc"), (None, "7.5")]
    assert rows(log, '"count = {x}" group by "all" as k select x, sum(x) as s') == [("all", "5\nabc\n7.5", 12.5)]
    assert rows(log, '"zzz" select count(*) as n') == [(0,)]
    assert rows(log, '"zzz" select distinct(v) as n') == []
    assert rows(log, '"[{id}]" group by id order by id desc') == [("3",), ("2",), ("1",)]


def test_order_limit_and_paging(log):
    assert rows(log, "* select v, n order by v limit 2") == [(None, 2.0), (0.0, 0.0)]
    assert rows(log, "* select v, n order by v desc limit 2") == [(5.0, 5.0), (4.0, 4.0)]
    assert rows(log, "* select w, n order by w limit 1")[0][1] == 3.0
    r = log.query("* select n")
    assert [x[0] for x in r.page(2, 3).collect()] == [2.0, 3.0, 4.0]
    assert sorted(tuple(x) for x in r.numbered().collect()) == [(k, float(k)) for k in range(6)]
    assert r.count() == 6 and "Select" in r.plan()


def test_parsers(spark):
    data = [(0, "a;b"), (1, '{"a": 1, "b": {"c": "x", "d": [true, null]}}'), (2, "[1, 2]"), (3, None), (4, "1;2;3"), (5, "1"), (6, "")]
    log = Log.from_table(spark.createDataFrame(data, "n long, line string"), "line", "n")
    got = log.query("* parse json").ordered().collect()
    assert got[1]["a"] == 1.0 and got[1]["b.c"] == "x" and got[1]["b.d.0"] is True and got[1]["message"] is None
    assert got[0]["message"] == "a;b" and got[0]["a"] is None
    got = log.query("* parse csv select a, b").ordered().collect()
    assert [tuple(r) for r in got][4:] == [("1", "2"), ("1", None), ("", None)] and tuple(got[0]) == (None, None)
    assert [tuple(r) for r in log.query("* parse test limit 1").df.collect()] == [(1.0, "2", 3.1)]
    empty = Log.from_table(spark.createDataFrame([], "n long, line string"), "line", "n")
    assert empty.query("* parse json").df.count() == 0 and empty.query("* parse csv").df.count() == 0


def test_long_durations_and_escaped_letters(spark):
    from lumenlog.functions.values import is_date_format, parse_duration

    df = spark.createDataFrame([("99999999999999999999",), ("99999999999",), ("1.02:03:04",), ("x",), ("0000000000000002",)], "t string")
    got = [r["v"].total_seconds() for r in df.select(parse_duration(F.col("t")).alias("v")).collect()]
    assert got == [0, 0, 93784, 0, 172800]
    assert is_date_format("yyyy\\eMM") and not is_date_format("yyyyeMM")


def test_captures_are_taken_once(spark):
    from lumenlog.queries import queries

    plan = queries()["capture_number"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 3 and plan.count("format_string") == 1
