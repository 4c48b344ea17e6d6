import duckdb
import pytest

from lumenlog import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if hasattr(x, "as_py"):
        x = x.as_py()
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = q.queries()[name](spark, SF)
    names = sorted(df.columns)
    expect = sql.execute(q.oracle_sql()[name])
    columns = [d[0] for d in expect.description]
    assert sorted(columns) == names
    theirs = [tuple(cell(r[columns.index(n)]) for n in names) for r in expect.fetchall()]
    ours = [tuple(cell(r[n]) for n in names) for r in df.collect()]
    assert ours, "a query without rows shows nothing"
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
