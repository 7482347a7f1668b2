"""Every registered query with SQL against DuckDB, over whole tables of the smallest size."""

import decimal

import duckdb
import pytest

from palimpsest.queries import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def value(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (list, tuple)):
        return [value(y) for y in x]
    return x


def rows(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([value(r[k]) for k in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)
