"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    cols = sorted(expected.columns)
    assert sorted(got.columns) == cols
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(expected))


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_flagship_prunes_columns_and_pushes_filters(spark):
    plan = QUERIES["join_where_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan


def test_shuffle_and_resize_cover_whole_tables(spark, duck):
    parts, customers = (duck.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("part", "customer"))
    assert sorted(r["dst"] for r in QUERIES["perfect_shuffle"](spark, SF).collect()) == list(range(parts))
    assert sorted(r["i"] for r in QUERIES["table_resize"](spark, SF).collect()) == list(range(6 * customers // 5))


def test_no_global_order_runs_in_one_task(spark):
    from tessera.operators.order import positions

    df = positions(spark.range(1000).selectExpr("id", "id % 7 as k"), ["k", "id"])
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((i % 7, i) for i in range(1000))
