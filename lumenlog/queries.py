"""Registered queries: each operator of the language over whole tables, with its SQL equivalent.

``VIEWS`` renders tables as logs. Each entry of ``CASES`` is a view, a query of the
language, and SQL that gives the same rows; queries that aren't plain language
(paging, context, charts, tokens, sources) are functions below.
"""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.functions import scalar
from lumenlog.functions.values import NUMBER, STRING, Value, convert
from lumenlog.operators import aggregates, charts, index, parsers, tokens
from lumenlog.plans.engine import Indexer, Log, context
from lumenlog.sources.catalog import Catalog, SavedQuery
from lumenlog.sources.files import MARKS, from_lines, read_log, read_splits
from lumenlog.sources.shared import folder, remove
from lumenlog.sources.sinks import row_text, write_csv
from lumenlog.streaming.logs import lines, on_change, transform

# ---------------------------------------------------------------- views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> Log:
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ["), F.col("user_id").cast("string"), F.lit("] "), F.col("event_type"),
        F.lit(" value="), F.format_string("%.2f", F.col("value")), F.lit(" "), F.col("props"),
    )
    return Log.from_table(_table(spark, sf_dir, "events"), line, "event_id")


def orders_log(spark: SparkSession, sf_dir: str) -> Log:
    line = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ORDER "), F.col("o_orderkey").cast("string"), F.lit(" customer="), F.col("o_custkey").cast("string"),
        F.lit(" status="), F.col("o_orderstatus"), F.lit(" priority="), F.col("o_orderpriority"),
    )
    return Log.from_table(_table(spark, sf_dir, "orders"), line, "o_orderkey")


def lineitem_log(spark: SparkSession, sf_dir: str) -> Log:
    return Log.from_table(_table(spark, sf_dir, "lineitem"), F.col("l_shipdate").cast("string"), ["l_orderkey", "l_linenumber"])


def part_log(spark: SparkSession, sf_dir: str) -> Log:
    return Log.from_table(_table(spark, sf_dir, "part"), "p_name", "p_partkey")


def documents_log(spark: SparkSession, sf_dir: str) -> Log:
    return from_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


def customers_csv(spark: SparkSession, sf_dir: str) -> Log:
    """A header line, then cells between semicolons."""
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("at"), F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("key;name;segment").alias("line"))
    return Log.from_table(head.unionAll(rows), "line", "at")


def nested_json(spark: SparkSession, sf_dir: str) -> Log:
    """Lines of nested JSON with arrays, and some lines that aren't JSON."""
    e = _table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("no json here")).otherwise(
        F.format_string('{"id": %d, "user": {"id": %d, "kind": "%s"}, "tags": [%d, %d], "ok": %s}', "event_id", "user_id", "event_type", F.col("event_id") % 3, F.col("event_id") % 5, (F.col("event_id") % 2 == 0).cast("string"))
    )
    return Log(e.select("event_id", line.alias("message")), ("event_id",))


VIEWS: dict[str, Callable[[SparkSession, str], Log]] = {
    "events": events_log, "orders": orders_log, "lineitem": lineitem_log, "part": part_log, "documents": documents_log, "customers": customers_csv, "nested": nested_json,
}

_EV = "(SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' [' || user_id || '] ' || event_type || ' value=' || printf('%.2f', value) || ' ' || props AS message FROM events)"
_OR = "(SELECT *, strftime(o_orderdate, '%Y-%m-%d') || ' ORDER ' || o_orderkey || ' customer=' || o_custkey || ' status=' || o_orderstatus || ' priority=' || o_orderpriority AS message FROM orders)"
_DOC = "(SELECT doc_id, unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS message FROM (SELECT doc_id, string_split(coalesce(\"text\", ''), chr(10)) AS ls FROM documents))"


def _fn(name: str, expression: str, sql: str) -> tuple[str, str, str, str]:
    return (f"fn_{name}", "lineitem", f"* select l_orderkey as k, l_linenumber as n, {expression} as v", f"SELECT l_orderkey::DOUBLE AS k, l_linenumber::DOUBLE AS n, {sql} AS v FROM lineitem")


def _where(name: str, expression: str, sql: str) -> tuple[str, str, str, str]:
    return (f"where_{name}", "lineitem", f"* where {expression} select l_orderkey as k, l_linenumber as n, l_quantity as q", f"SELECT l_orderkey::DOUBLE AS k, l_linenumber::DOUBLE AS n, l_quantity AS q FROM lineitem WHERE {sql}")


def _search(name: str, view: str, query: str, source: str, condition: str) -> tuple[str, str, str, str]:
    return (f"search_{name}", view, query, f"SELECT message FROM {source} WHERE {condition}")


_X = "(l_quantity - 25)"
_XS = "(l_quantity - 25)"

#: name, view, query, SQL
CASES: list[tuple[str, str, str, str]] = [
    # search
    _search("scan", "events", "*", _EV, "true"),
    _search("empty", "orders", "", _OR, "true"),
    _search("bare_text", "events", "purchase value", _EV, "contains(message, 'purchase value')"),
    _search("phrase", "events", '"purchase"', _EV, "contains(message, ' purchase ')"),
    _search("phrase_exact", "events", '!"error value=1"', _EV, "contains(message, ' error value=1')"),
    _search("phrase_token", "documents", '"and"', _DOC, "regexp_matches(message, '(^|[^\\p{L}])and([^\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]|$)')"),
    _search("phrase_two_tokens", "documents", '"the and"', _DOC, "regexp_matches(message, '(^|[^\\p{L}])the and([^\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]|$)')"),
    _search("phrase_short", "events", '"] v"', _EV, "contains(message, '] v')"),
    _search("wildcard_star", "orders", '"ORDER*status=F"', _OR, "regexp_matches(message, 'ORDER.*status=F')"),
    _search("wildcard_any", "orders", '"status=? priority"', _OR, "regexp_matches(message, 'status=. priority')"),
    _search("and", "events", '"click" and "value=1"', _EV, "contains(message, ' click ') AND contains(message, 'value=1')"),
    _search("or", "events", '"click" or "error"', _EV, "contains(message, ' click ') OR contains(message, ' error ')"),
    _search("xor", "events", '"click" xor "value=1"', _EV, "contains(message, ' click ') <> contains(message, 'value=1')"),
    _search("not", "events", 'not "click"', _EV, "NOT contains(message, ' click ')"),
    _search("nested", "events", '("click" or "view") and not "value=1"', _EV, "(contains(message, ' click ') OR contains(message, ' view ')) AND NOT contains(message, 'value=1')"),
    _search("precedence", "events", '"click" or "view" and "value=1"', _EV, "contains(message, ' click ') OR (contains(message, ' view ') AND contains(message, 'value=1'))"),
    _search("escape", "events", '"\\\\{\\"k\\": 8"', _EV, "contains(message, '{\"k\": 8')"),
    ("capture_string", "orders", '"customer={who} status={state} priority={rest}" select who, state, rest', f"SELECT regexp_extract(message, 'customer=(\\d+)', 1) AS who, o_orderstatus AS state, o_orderpriority AS rest FROM {_OR}"),
    ("capture_number", "events", '"[{user:number}] {kind} value={value:number} " where value > 50 select user, kind, value', "SELECT user_id::DOUBLE AS user, event_type AS kind, value FROM events WHERE value > 50"),
    ("capture_number_rejects", "orders", '"priority={p:number}-" select p', "SELECT substr(o_orderpriority, 1, 1)::DOUBLE AS p FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]+-')"),
    ("capture_time", "events", '"{at:time} [" select at', "SELECT date_trunc('milliseconds', ts) AS at FROM events"),
    ("capture_time_format", "orders", '"{day:yyyy-MM-dd} ORDER" select day', "SELECT date_trunc('day', o_orderdate) AS day FROM orders"),
    ("capture_or_first", "events", '"click value={v:number} " or "view value={v:number} " select v', "SELECT CASE WHEN event_type IN ('click', 'view') THEN value END AS v FROM events WHERE event_type IN ('click', 'view')"),
    ("marker", "events", '"click":tag="C" or "error":tag="E" select tag', "SELECT CASE event_type WHEN 'click' THEN 'C' ELSE 'E' END AS tag FROM events WHERE event_type IN ('click', 'error')"),
    # parse
    ("parse_json", "events", "* parse json(props) where k > 50 select k", "SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50"),
    ("parse_json_nested", "nested", "* parse json select id, user.id as u, user.kind as kind, `tags.0` as t0, `tags.1` as t1, ok == true as ok", "SELECT CASE WHEN event_id % 10 <> 0 THEN event_id::DOUBLE END AS id, CASE WHEN event_id % 10 <> 0 THEN user_id::DOUBLE END AS u, CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 10 <> 0 THEN (event_id % 3)::DOUBLE END AS t0, CASE WHEN event_id % 10 <> 0 THEN (event_id % 5)::DOUBLE END AS t1, event_id % 10 <> 0 AND event_id % 2 = 0 AS ok FROM events"),
    ("parse_json_failed", "nested", "* parse json where id == nothing select message", "SELECT 'no json here' AS message FROM events WHERE event_id % 10 = 0"),
    ("parse_csv", "customers", '* parse csv where segment == "BUILDING" select key, name, segment', "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    ("parse_csv_header", "customers", "* parse csv where key == nothing select message", "SELECT 'key;name;segment' AS message"),
    ("parse_test", "orders", "* parse test", "SELECT 1.0::DOUBLE AS \"A\", '2' AS \"B\", 3.1::DOUBLE AS \"C\" FROM orders"),
    # where
    _where("arithmetic", "l_quantity * 2 + 1 - l_tax > 50 and l_quantity / 2 < 20", "l_quantity * 2 + 1 - l_tax > 50 AND l_quantity / 2 < 20"),
    _where("divide_by_zero", "1 / (l_quantity - 25) > 1000", "l_quantity = 25"),
    _where("remainder", "l_quantity % 7 == 3", "l_quantity % 7 = 3"),
    _where("remainder_of_zero", "not (l_quantity % 0 == l_quantity % 0)", "true"),
    _where("power", "l_quantity ^ 2 >= 900", "l_quantity ^ 2 >= 900"),
    _where("unary_minus", "-l_quantity < -40", "-l_quantity < -40"),
    _where("equal_text", 'l_returnflag == "R"', "l_returnflag = 'R'"),
    _where("not_equal", 'l_returnflag != "R" and l_linestatus != "O"', "l_returnflag <> 'R' AND l_linestatus <> 'O'"),
    _where("null_equals_null", "nothing == missing and l_quantity >= 49", "l_quantity >= 49"),
    _where("null_compares_false", "nothing > 1 or l_quantity <= 2", "l_quantity <= 2"),
    _where("xor", "l_quantity > 25 xor l_discount > 0.05", "(l_quantity > 25) <> (l_discount > 0.05)"),
    _where("not", "not l_quantity > 3", "NOT l_quantity > 3"),
    _where("or_and", "l_quantity < 3 or l_quantity > 48 and l_tax == 0", "l_quantity < 3 OR (l_quantity > 48 AND l_tax = 0)"),
    _where("parentheses", "(l_quantity < 3 or l_quantity > 48) and true", "l_quantity < 3 OR l_quantity > 48"),
    _where("coercion", '"40" < l_quantity and number("45") >= l_quantity', "l_quantity > 40 AND l_quantity <= 45"),
    _where("time", 'l_shipdate >= time("1997-01-01", "yyyy-MM-dd") and l_shipdate < time("1997-03-01", "yyyy-MM-dd")', "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-03-01'"),
    ("where_backquote", "events", "* where `value` > 100 select `user_id` as u", "SELECT user_id::DOUBLE AS u FROM events WHERE value > 100"),
    ("where_time_minus_time", "events", '* where ts - time("2024-01-01", "yyyy-MM-dd") < duration("12:00") select event_id as id', "SELECT event_id::DOUBLE AS id FROM events WHERE ts < TIMESTAMP '2024-01-01 12:00:00'"),
    # functions
    _fn("abs", f"abs{_X}", f"abs{_XS}"),
    _fn("sqrt", f"round(sqrt{_X} * 1000)", f"CASE WHEN l_quantity < 25 THEN 'NaN'::DOUBLE ELSE round_even(sqrt(greatest(l_quantity - 25, 0)) * 1000, 0) END"),
    _fn("sin", f"round(sin{_X} * 1000)", f"round_even(sin{_XS} * 1000, 0)"),
    _fn("cos", f"round(cos{_X} * 1000)", f"round_even(cos{_XS} * 1000, 0)"),
    _fn("tan", f"round(tan{_X} * 1000)", f"round_even(tan{_XS} * 1000, 0)"),
    _fn("exp", "round(exp(l_discount) * 1000)", "round_even(exp(l_discount) * 1000, 0)"),
    _fn("log", f"round(log{_X} * 1000)", "CASE WHEN l_quantity < 25 THEN 'NaN'::DOUBLE WHEN l_quantity = 25 THEN '-inf'::DOUBLE ELSE round_even(ln(greatest(l_quantity - 25, 1)) * 1000, 0) END"),
    _fn("round", "round(l_quantity / 2)", "round_even(l_quantity / 2, 0)"),
    _fn("ceil", "ceil(l_extendedprice)", "ceil(l_extendedprice)"),
    _fn("floor", "floor(l_extendedprice)", "floor(l_extendedprice)"),
    _fn("trunc", f"trunc({_X} / 4)", f"trunc({_XS} / 4)"),
    _fn("min", "min(l_quantity, 10)", "least(l_quantity, 10.0)"),
    _fn("max", "max(l_quantity, nothing)", "l_quantity"),
    _fn("pow", "pow(l_quantity, 2)", "pow(l_quantity, 2)"),
    _fn("pow_null", "pow(l_quantity, nothing)", "'NaN'::DOUBLE"),
    _fn("abs_null", "abs(nothing)", "'NaN'::DOUBLE"),
    _fn("number", "number(l_returnflag)", "NULL::DOUBLE"),
    _fn("bin_number", "bin(l_quantity, 10)", "round_even(l_quantity / 10, 0) * 10"),
    _fn("bin_number_text", 'bin(l_extendedprice, "1000")', "round_even(l_extendedprice / 1000, 0) * 1000"),
    _fn("bin_time", 'bin(l_shipdate, "7.00:00:00")', "TIMESTAMP '0001-01-01' + to_days((date_diff('day', DATE '0001-01-01', l_shipdate::DATE) // 7 * 7)::INTEGER)"),
    _fn("time_failed", 'time(l_returnflag, "yyyy-MM-dd") < time("0001-01-02", "yyyy-MM-dd")', "true"),
    ("fn_bin_time_minutes", "events", '* select event_id as id, bin(ts, "00:10:00") as v', "SELECT event_id::DOUBLE AS id, make_timestamp((epoch_us(ts) + 62135596800000000) // 600000000 * 600000000 - 62135596800000000) AS v FROM events"),
    ("fn_duration", "events", '* where duration("1.02:03:04") > duration("1.00:00") select event_id as id', "SELECT event_id::DOUBLE AS id FROM events"),
    ("fn_bin_time_interval", "events", '* select event_id as id, bin(ts, duration("01:00")) as v', "SELECT event_id::DOUBLE AS id, date_trunc('hour', ts) AS v FROM events"),
    ("fn_bin_text_text", "orders", '* select o_orderkey as k, bin("1995-03-04 05:06:07,000", "01:00") as v', "SELECT o_orderkey::DOUBLE AS k, TIMESTAMP '1995-03-04 05:00:00' AS v FROM orders"),
    ("fn_bin_interval_interval", "events", '* where bin(ts - time("2024-01-01", "yyyy-MM-dd"), duration("1.00:00")) == duration("2") select event_id as id', "SELECT event_id::DOUBLE AS id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'"),
    ("fn_time_text", "events", '"{at} [" select event_id as id, time(at) as v', "SELECT event_id::DOUBLE AS id, date_trunc('milliseconds', ts) AS v FROM events"),
    ("fn_time_object", "events", "* select event_id as id, time(ts) as v", "SELECT event_id::DOUBLE AS id, ts AS v FROM events"),
    ("fn_duration_column", "part", '* where duration(p_name) == duration("0") select p_partkey as k', "SELECT p_partkey::DOUBLE AS k FROM part"),
    ("fn_number_column", "orders", '"ORDER {n} customer" select o_orderkey as k, number(n) as v', "SELECT o_orderkey::DOUBLE AS k, o_orderkey::DOUBLE AS v FROM orders"),
    ("fn_bin_duration", "events", '* where bin(ts - time("2024-01-01", "yyyy-MM-dd"), "1.00:00:00") == duration("2") select event_id as id', "SELECT event_id::DOUBLE AS id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'"),
    ("fn_contains", "part", '* where contains(p_name, "a") select p_partkey as k', "SELECT p_partkey::DOUBLE AS k FROM part WHERE contains(p_name, 'a')"),
    ("fn_startswith", "part", '* where startswith(p_brand, "Brand#1") select p_partkey as k', "SELECT p_partkey::DOUBLE AS k FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    ("fn_endswith", "part", '* where endswith(p_brand, "3") select p_partkey as k', "SELECT p_partkey::DOUBLE AS k FROM part WHERE p_brand LIKE '%3'"),
    ("fn_matches", "part", '* where matches(p_type, "*E*D") select p_partkey as k', "SELECT p_partkey::DOUBLE AS k FROM part WHERE p_type LIKE '%E%D%'"),
    ("fn_trim_length", "part", "* select p_partkey as k, length(trim(p_name)) as n", "SELECT p_partkey::DOUBLE AS k, length(trim(p_name))::DOUBLE AS n FROM part"),
    # aggregates
    ("agg_count", "events", '"click" select count(*) as n, count(value) as v, count(nothing) as z', "SELECT count(*) AS n, count(value) AS v, 0::BIGINT AS z FROM events WHERE event_type = 'click'"),
    ("agg_count_true", "events", "* select count(value > 50) as n", "SELECT count(*) FILTER (value > 50) AS n FROM events"),
    ("agg_sum", "lineitem", "* select sum(l_quantity) as s, sum(nothing) as z", "SELECT sum(l_quantity) AS s, 0::DOUBLE AS z FROM lineitem"),
    ("agg_mean", "lineitem", "* select mean(l_quantity) as m, mean(nothing) as z", "SELECT avg(l_quantity) AS m, 'NaN'::DOUBLE AS z FROM lineitem"),
    ("agg_median", "lineitem", "* select median(l_quantity) as m", "SELECT median(l_quantity) AS m FROM lineitem"),
    ("agg_min_max", "lineitem", "* select min(l_extendedprice) as a, max(l_extendedprice) as b", "SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem"),
    ("agg_first_last", "events", "* select first(value) as a, last(event_type) as b", "SELECT arg_min(value, event_id) AS a, arg_max(event_type, event_id) AS b FROM events"),
    ("agg_most_least", "events", "* select most(event_type) as a, least(event_type) as b", "SELECT (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS a, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS b"),
    ("agg_distinct", "events", "* select distinct(event_type) as t", "SELECT DISTINCT event_type AS t FROM events"),
    ("agg_zip", "events", "* select max(value) as n, distinct(event_type) as t", "SELECT CASE WHEN row_number() OVER (ORDER BY t) = 1 THEN (SELECT max(value) FROM events) END AS n, t FROM (SELECT DISTINCT event_type AS t FROM events)"),
    ("agg_list", "events", '"value=99" select max(value) as n, event_id as id', "SELECT CASE WHEN row_number() OVER (ORDER BY event_id) = 1 THEN max(value) OVER () END AS n, event_id::DOUBLE AS id FROM " + _EV + " WHERE contains(message, 'value=99.')"),
    ("agg_no_rows", "events", '"zzz" select count(*) as n, sum(value) as s, min(value) as m', "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::DOUBLE AS m"),
    ("group_keys", "events", "* group by event_type as t", "SELECT DISTINCT event_type AS t FROM events"),
    ("group_count", "events", "* group by event_type as t select count(*) as n, sum(value) as s, mean(value) as m, min(value) as a, max(value) as b", "SELECT event_type AS t, count(*) AS n, sum(value) AS s, avg(value) AS m, min(value) AS a, max(value) AS b FROM events GROUP BY 1"),
    ("group_expression", "lineitem", "* group by bin(l_quantity, 10) as q, l_returnflag as f select count(*) as n, median(l_discount) as m", "SELECT round_even(l_quantity / 10, 0) * 10 AS q, l_returnflag AS f, count(*) AS n, median(l_discount) AS m FROM lineitem GROUP BY 1, 2"),
    ("group_null_key", "events", '"click" or "view":tag="V" group by tag select count(*) as n', "SELECT CASE WHEN event_type = 'view' THEN 'V' END AS tag, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"),
    ("group_first_last", "events", "* group by user_id as u select first(event_type) as a, last(value) as b", "SELECT user_id::DOUBLE AS u, arg_min(event_type, event_id) AS a, arg_max(value, event_id) AS b FROM events GROUP BY 1"),
    ("group_most_least", "events", "* group by user_id as u select most(event_type) as a, least(event_type) as b", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id::DOUBLE AS u, arg_min(event_type, (-n, event_type)) AS a, arg_min(event_type, (n, event_type)) AS b FROM c GROUP BY 1"),
    ("group_distinct", "events", "* group by user_id as u select distinct(event_type) as t", "SELECT user_id::DOUBLE AS u, string_agg(event_type, chr(10) ORDER BY event_type) AS t FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1"),
    ("group_list", "orders", "* group by o_custkey as c select o_orderstatus as s", "SELECT o_custkey::DOUBLE AS c, string_agg(o_orderstatus, chr(10) ORDER BY o_orderkey) AS s FROM orders GROUP BY 1"),
    ("group_time_bins", "events", '* group by bin(ts, "01:00:00") as h select count(*) as n', "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1"),
    ("group_coerced", "orders", '"priority={p}-" group by o_orderstatus as s select sum(p) as t', "SELECT o_orderstatus AS s, sum(substr(o_orderpriority, 1, 1)::DOUBLE) AS t FROM orders WHERE contains(o_orderpriority, '-') GROUP BY 1"),
    # projection, order, limit
    ("select_alias", "orders", '* select o_orderkey as "Order Key", o_totalprice * 2 as Twice', "SELECT o_orderkey::DOUBLE AS \"Order Key\", o_totalprice * 2 AS \"Twice\" FROM orders"),
    ("select_unaliased", "orders", "* select o_totalprice / 4", "SELECT o_totalprice / 4 AS \"o_totalprice / 4\" FROM orders"),
    ("order_limit", "orders", "* select o_orderkey as k, o_totalprice as p order by p desc limit 25", "SELECT o_orderkey::DOUBLE AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25"),
    ("order_many", "orders", "* select o_orderkey as k, o_orderstatus as s, o_custkey as c order by s asc, c desc limit 40", "SELECT o_orderkey::DOUBLE AS k, o_orderstatus AS s, o_custkey::DOUBLE AS c FROM orders ORDER BY s, c DESC, o_orderkey LIMIT 40"),
    ("order_nulls", "events", '"click" or "view value={v:number} " select event_id as id, v order by v limit 4000', "SELECT event_id::DOUBLE AS id, CASE WHEN event_type = 'view' THEN value END AS v FROM events WHERE event_type IN ('click', 'view') ORDER BY v NULLS FIRST, id LIMIT 4000"),
    ("limit_in_log_order", "events", '"error" select event_id as id limit 30', "SELECT event_id::DOUBLE AS id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 30"),
    ("group_order_limit", "events", '"{at:time} [{user:number}] {kind} value={value:number} " where value > 100 group by kind as Kind select count(*) as N, mean(value) as Avg order by N desc limit 3', "SELECT event_type AS \"Kind\", count(*) AS \"N\", avg(value) AS \"Avg\" FROM events WHERE value > 100 GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 3"),
]


def _case(view: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: VIEWS[view](spark, sf_dir).query(text).df


# ---------------------------------------------------------------- beyond the language


def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).query("* select o_orderkey as k, o_totalprice as p order by p").page(100, 50)


def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).query('* where o_orderstatus == "F" select o_orderkey as k').numbered("place")


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(events_log(spark, sf_dir), F.col("value") > 200).select("hit", "distance", "index", "event_id")


def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return log.at(_table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))).query('"ORDER" select o_orderkey as k').df


def column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events_log(spark, sf_dir).query('"{at:time} [{user:number}] {kind} value" select at, user, kind, at - at as none')
    return spark.createDataFrame(r.describe(), "name string, kind string, format string")


def token_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(orders_log(spark, sf_dir).df)


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.estimate(events_log(spark, sf_dir).df, "purchase value")


def token_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    path = folder(spark, "token-index")
    index.write(log, path)
    return index.candidates(spark, path, log, "URGENT").query('"URGENT"').df


def chart_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.samples(events_log(spark, sf_dir).query("* select ts as t, value as v").df, "t", "v")


def chart_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events_log(spark, sf_dir).query("* group by user_id as u select count(*) as n order by n desc, u")
    return charts.categories(r, "u", "n").select("category", "amount")


def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.labels(events_log(spark, sf_dir).query("* select event_type as t").df, "t")


def chart_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.limits(lineitem_log(spark, sf_dir).query("* select l_quantity as a, l_extendedprice as b").df, "a", "b")


def chart_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.shares(events_log(spark, sf_dir).query("* group by event_type as t select sum(value) as v").df, "t", "v").select("category", F.round("share", 9).alias("share"))


def file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to files by Spark and read back as a log."""
    path = folder(spark, "orders-log")
    orders_log(spark, sf_dir).df.select(F.col("message").alias("value")).write.mode("overwrite").text(path)
    return read_log(spark, f"{path}/part-").query('"status=F"').df


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "csv-export") + "/rows"
    write_csv(customers_csv(spark, sf_dir).query("* parse csv where key != nothing select key, name, segment").df, path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_text(orders_log(spark, sf_dir).query("* select o_orderstatus as s, o_orderpriority as p, o_orderdate as d").df)


def _streamed(spark: SparkSession, sf_dir: str, text: str, mode: str) -> DataFrame:
    """A query over files as they arrive, run until none is left."""
    path = folder(spark, "arriving")
    orders_log(spark, sf_dir).df.select(F.col("message").alias("value")).write.text(path)
    name = "streamed_" + path.rsplit("-", 1)[1]
    stream = transform(lines(spark, path), text).writeStream.outputMode(mode).format("memory").queryName(name)
    stream.option("checkpointLocation", folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def streaming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, '"customer={c:number} status=F" where c < 50 select c', "append")


def streaming_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, '"customer={c:number} status={s} " group by s select count(*) as n, sum(c) as t', "complete")


def saved_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query kept in a catalogue and run by its title."""
    with tempfile.TemporaryDirectory() as place:  # read and written by the driver alone
        catalog = Catalog(f"{place}/own.xml")
        catalog.save(SavedQuery("open orders", '"status=O" select o_orderkey as k'))
        return orders_log(spark, sf_dir).query(catalog.get("open orders").query).df


def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = orders_log(spark, sf_dir).query('"ORDER" and not "URGENT" where o_totalprice > 5 select o_orderkey as k order by k limit 3')
    return spark.createDataFrame([(n, line) for n, line in enumerate(r.plan().split("\n"))], "n long, line string")


def whole_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).read().select("o_orderkey", "message")


def context_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(events_log(spark, sf_dir), F.col("event_id") == 2, pad=True, names=("of", "off", "place")).select("of", "off", "place", "event_id")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file in the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def _nation_lines(spark: SparkSession, sf_dir: str) -> list[str]:
    """A line for each of the 25 nations."""
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(25).collect()
    return [f"nation {r['n_nationkey']} named {r['n_name']} in {r['n_regionkey']}" for r in rows]


def zip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of two members: even and odd lines."""
    made, said = io.BytesIO(), _nation_lines(spark, sf_dir)
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("m1.log", "\n".join(said[::2]))
        z.writestr("m2.log", "\r\n".join(said[1::2]) + "\r\n")
    path = folder(spark, "zipped") + ".zip"
    _put(spark, path, made.getvalue())
    return read_log(spark, path).query('"nation {k:number} named" where k > 3 select k, member, line').df


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines in files of different encodings, told by their first bytes."""
    path, said = folder(spark, "encoded"), "\n".join(_nation_lines(spark, sf_dir)[:5])
    for n, (mark, name) in enumerate(MARKS[:5]):
        _put(spark, f"{path}/log.{n}", mark + said.encode(name))
    return read_log(spark, path).query('"nation {k:number} named {name} in" group by k, name select count(*) as n').df


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of log rotation."""
    path = folder(spark, "rotated")
    for name in ("log.1.2", "log.5", "log.10", "log"):
        _put(spark, f"{path}/{name}", name.encode())
    return read_log(spark, path).query("*").numbered("place")


def splits_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "split")
    orders_log(spark, sf_dir).df.select(F.col("message").alias("value")).write.text(path)
    return read_splits(spark, path).query('"status=O" group by file select count(*) as n').df.agg(F.sum("n").cast("long").alias("n"))


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query run again after one file changed, one went and one came."""
    path, said = folder(spark, "growing"), _nation_lines(spark, sf_dir)
    for n in range(3):
        _put(spark, f"{path}/log.{n}", "\n".join(said[n * 5 : n * 5 + 5]).encode())
    ix = index.LogIndex(spark, folder(spark, "growing-index"), [path])
    ix.refresh()
    _put(spark, f"{path}/log.0", "\n".join(said[15:25]).encode())
    _put(spark, f"{path}/log.3", said[0].encode())
    remove(spark, f"{path}/log.2")
    return ix.query('"nation {k:number} named" select k', "nation")


def _indexed(spark: SparkSession, log: Log) -> DataFrame:
    path = folder(spark, "token-index")
    index.write(log, path)
    return spark.read.parquet(path)


def index_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which one token stands right of another."""
    log = documents_log(spark, sf_dir)
    return index.matching(_indexed(spark, log), log, ["the", "and"]).df.select("doc_id", "line")


def index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    found = index.matching(_indexed(spark, log), log, index.phrase_tokens("URGENT"), exact=True)
    both = index.matching(_indexed(spark, log), log, index.phrase_tokens("status=F priority"), exact=True)
    return found.df.select("o_orderkey", F.lit("one").alias("how")).union(both.df.select("o_orderkey", F.lit("two")))


def index_no_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = part_log(spark, sf_dir)
    return index.matching(_indexed(spark, log), log, []).df.select("p_partkey")


def index_append_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of an index to which a second file's lines were added and from which the first file's were taken."""
    n = _table(spark, sf_dir, "nation")
    def log(file, low, high):
        return Log(n.filter((F.col("n_nationkey") >= low) & (F.col("n_nationkey") < high)).select(F.lit(file).alias("file"), F.col("n_nationkey").cast("long").alias("position"), F.col("n_name").alias("message")), ("position",))
    path = folder(spark, "token-index")
    index.write(log("a", 0, 10), path)
    index.write(log("b", 10, 15), path, "append")
    index.write(log("b", 15, 25), path, "append")
    return index.remove(spark.read.parquet(path), "a").select("token", "position")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was told of new lines, batch by batch."""
    path, told = folder(spark, "arriving"), folder(spark, "told")
    orders_log(spark, sf_dir).df.select(F.col("message").alias("value")).write.text(path)
    act = lambda batch, n: batch.agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(told)
    stream = transform(lines(spark, path), '"status=P"')
    on_change(stream, act, folder(spark, "stream-state")).processAllAvailable()
    return spark.read.parquet(told).agg(F.sum("n").cast("long").alias("n"))


def streaming_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned times behind a watermark."""
    path = folder(spark, "arriving")
    _table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(path).withColumn("message", F.col("event_type"))
    name = "binned_" + path.rsplit("-", 1)[1]
    out = transform(stream, '* group by bin(ts, "01:00:00") as h select count(*) as n', late="1 hour", time="ts")
    out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function, aggregate and parser in one query."""
    scalar.register("twice", 1, 1, lambda args, raw: Value(convert(args[0], NUMBER).col * 2, NUMBER))
    aggregates.register("spread", lambda v, key: (F.max(convert(v, NUMBER).col) - F.min(convert(v, NUMBER).col), NUMBER))
    parsers.register("dashes", lambda log, text, key: parsers.Parsed(F.contains(text, F.lit("-")), {"level": Value(F.substring_index(text, "-", 1), STRING)}, False))
    return orders_log(spark, sf_dir).query("* parse dashes(o_orderpriority) where level != nothing group by level as p select spread(twice(number(level))) as z, count(*) as n").df


class _Counts(Indexer):
    """A plugin that counts lines, and is told before and after."""

    def __init__(self):
        self.told: list[str] = []

    def initialize(self, columns: list[str]) -> None:
        self.told.append("begin")

    def update(self, log: Log) -> DataFrame:
        self.told.append("update")
        return log.df.agg(F.count(F.lit(1)).alias("n"))

    def complete(self, error: Exception | None) -> None:
        self.told.append("end")


def plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Counts()
    return orders_log(spark, sf_dir).index_with({"counts": p})["counts"].withColumn("told", F.lit(" ".join(p.told)))


def _refused(build: Callable[[], object]) -> bool:
    try:
        build()
    except QueryError:
        return True
    return False


def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which patterns, calls and charts are refused."""
    log = part_log(spark, sf_dir)
    said = ['"{"', '"a{}"', '"a**b"', '"{a}{b}"', '"a?b"', "* select mean(p_size, 1)", "* select min(p_size, 1)", "* select nope(1)", "* parse nope"]
    rows = [(t, _refused(lambda t=t: log.query(t))) for t in said]
    df = log.query("* select p_name, p_size").df
    rows += [(f"{kind} {axis}", _refused(lambda k=kind, a=axis: charts.check(k, df, a))) for kind in ("column", "pie", "line", "step", "point") for axis in ("p_name", "p_size")]
    return spark.createDataFrame(rows, "what string, refused boolean")


FUNCTIONS: list[tuple[Callable[[SparkSession, str], DataFrame], str | None]] = [
    (paging, "SELECT o_orderkey::DOUBLE AS k, o_totalprice AS p FROM orders ORDER BY p, o_orderkey LIMIT 50 OFFSET 100"),
    (row_places, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey::DOUBLE AS k FROM orders WHERE o_orderstatus = 'F'"),
    (context_lines, "WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS index, event_id, value FROM events) SELECT h.index AS hit, r.index - h.index AS distance, r.index AS index, r.event_id FROM r JOIN r AS h ON r.index BETWEEN h.index - 5 AND h.index + 5 WHERE h.value > 200"),
    (random_access, "SELECT o_orderkey::DOUBLE AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"),
    (column_metadata, "SELECT * FROM (VALUES ('at', 'time', 'yyyy-MM-dd HH:mm:ss,SSS'), ('user', 'number', ''), ('kind', 'string', ''), ('none', 'duration', '')) AS t(name, kind, format)"),
    (token_vocabulary, f"WITH t AS (SELECT o_orderkey, unnest(regexp_extract_all(regexp_replace(message, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[0-9]+|[A-Za-z]+')) AS token FROM {_OR}) SELECT token, count(DISTINCT o_orderkey) AS lines, count(*) AS occurrences FROM t WHERE length(token) >= 3 GROUP BY 1"),
    (token_estimate, "SELECT count(*) FILTER (event_type = 'purchase') AS estimate FROM events"),
    (token_index_search, f"SELECT message FROM {_OR} WHERE regexp_matches(message, 'URGENT')"),
    (chart_samples, "SELECT (epoch_us(ts) * 10 + 621355968000000000)::DOUBLE AS x, value AS y FROM events"),
    (chart_categories, "WITH g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1) SELECT CASE WHEN r <= 10 THEN user_id || '.0' ELSE 'Other' END AS category, sum(n)::DOUBLE AS amount FROM g GROUP BY 1"),
    (chart_labels, "SELECT DISTINCT event_type AS label FROM events"),
    (chart_limits, "SELECT least(min(l_quantity), min(l_extendedprice)) AS low, greatest(max(l_quantity), max(l_extendedprice)) AS high FROM lineitem"),
    (chart_shares, "SELECT event_type AS category, round(sum(value) / (SELECT sum(value) FROM events), 9) AS share FROM events GROUP BY 1"),
    (file_source, f"SELECT message FROM {_OR} WHERE o_orderstatus = 'F'"),
    (csv_sink, "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer"),
    (text_sink, "SELECT o_orderstatus || chr(9) || o_orderpriority || chr(9) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S,%g') AS value FROM orders"),
    (streaming_search, "SELECT o_custkey::DOUBLE AS c FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50"),
    (streaming_groups, "SELECT o_orderstatus AS s, count(*) AS n, sum(o_custkey)::DOUBLE AS t FROM orders GROUP BY 1"),
    (saved_query, "SELECT o_orderkey::DOUBLE AS k FROM orders WHERE o_orderstatus = 'O'"),
    (plan_text, "SELECT n::BIGINT AS n, line FROM (VALUES (0, '+ Limit [3]'), (1, '  + OrderBy [k asc]'), (2, '    + Select [k]'), (3, '      + Where [Binary(op=''>'', left=Field(name=''o_totalprice''), right=Literal(value=5.0))]'), (4, '        + And'), (5, '          + Phrase [''ORDER'']'), (6, '          + Not'), (7, '            + Phrase [''URGENT'']')) AS t(n, line)"),
    (whole_read, f"SELECT o_orderkey, message FROM {_OR}"),
    (context_padded, "SELECT 2::BIGINT AS of, d AS off, CASE WHEN d >= -2 THEN d + 2 END AS place, CASE WHEN d >= -2 THEN d + 2 END AS event_id FROM (SELECT unnest(range(-5, 6)) AS d)"),
    (zip_source, "SELECT k::DOUBLE AS k, CASE WHEN k % 2 = 0 THEN 'm1.log' ELSE 'm2.log' END AS member, (k // 2 + 1)::DOUBLE AS line FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 4 AND 24)"),
    (encodings, "SELECT n_nationkey::DOUBLE AS k, n_name AS name, 5::BIGINT AS n FROM nation WHERE n_nationkey < 5"),
    (file_order, "SELECT * FROM (VALUES (0::BIGINT, 'log.1.2'), (1::BIGINT, 'log.10'), (2::BIGINT, 'log.5'), (3::BIGINT, 'log')) AS t(place, message)"),
    (splits_source, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'"),
    (refreshed, "SELECT n_nationkey::DOUBLE AS k FROM nation WHERE n_nationkey BETWEEN 15 AND 24 OR n_nationkey BETWEEN 5 AND 9 OR n_nationkey = 0"),
    (index_positions, f"SELECT doc_id, line::INTEGER AS line FROM (SELECT doc_id, unnest(ls) AS message, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, string_split(coalesce(\"text\", ''), chr(10)) AS ls FROM documents))) WHERE regexp_matches(message, '(^|[^\\p{{L}}])the([^\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}].*|[^\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}])and([^\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]|$)') AND regexp_matches(message, '(^|[^\\p{{L}}])the([^\\p{{L}}]|[^\\p{{L}}].*[^\\p{{L}}])and([^\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]|$)')"),
    (index_exact, "SELECT o_orderkey, 'one' AS how FROM orders WHERE contains(o_orderpriority, 'URGENT') UNION ALL SELECT o_orderkey, 'two' FROM orders"),
    (index_no_tokens, "SELECT p_partkey FROM part"),
    (index_append_remove, "SELECT unnest(regexp_extract_all(n_name, '[A-Za-z]+|[0-9]{3,}')) AS token, n_nationkey::BIGINT AS position FROM nation WHERE n_nationkey >= 10"),
    (change_events, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'"),
    (streaming_bins, "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1"),
    (registries, "SELECT split_part(o_orderpriority, '-', 1) AS p, 0::DOUBLE AS z, count(*) AS n FROM orders WHERE contains(o_orderpriority, '-') GROUP BY 1"),
    (plugin, "SELECT count(*) AS n, 'begin update end' AS told FROM orders"),
    (refused_queries, "SELECT * FROM (VALUES ('\"{\"', true), ('\"a{}\"', true), ('\"a**b\"', true), ('\"{a}{b}\"', true), ('\"a?b\"', false), ('* select mean(p_size, 1)', true), ('* select min(p_size, 1)', false), ('* select nope(1)', true), ('* parse nope', true), ('column p_name', false), ('column p_size', true), ('pie p_name', false), ('pie p_size', true), ('line p_name', true), ('line p_size', false), ('step p_name', true), ('step p_size', false), ('point p_name', true), ('point p_size', false)) AS t(what, refused)"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _case(view, text) for name, view, text, _ in CASES} | {f.__name__: f for f, _ in FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, _, sql in CASES} | {f.__name__: sql for f, sql in FUNCTIONS if sql}


FLAGSHIP = next(text for name, _, text, _ in CASES if name == "group_order_limit")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).query(FLAGSHIP).df


__all__ = ["FLAGSHIP", "flagship", "oracle_sql", "queries"]
