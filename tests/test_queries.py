"""Every query that has SQL against it, over whole tables."""

import math

import duckdb
import pytest

from meshwork import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-9))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = db.sql(catalog.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_every_lineitem_is_an_edge(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    assert catalog.queries()["edge_count"](spark, sf_dir).first()[0] == 2 * pairs
