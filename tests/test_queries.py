"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from sievelake.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 5) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(result.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_filters_reach_the_scan(spark, sf):
    plan = queries.QUERIES["flagship"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "l_comment" not in plan


def test_pages_are_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in queries.QUERIES["search_after"](spark, sf)._jdf.queryExecution().toString()
