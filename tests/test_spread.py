"""Costly work on each row is shared by the cores, however few row groups a table has."""

import datetime
from decimal import Decimal

import pytest

from eventloom.plans import registry, registry_sources
from eventloom.session import spread


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders, customers and nations of a few rows, each in one file of one row group; some rows occur twice."""
    root = str(tmp_path_factory.mktemp("one_row_group"))
    orders = [(k, 1 + k % 7, "FOP"[k % 3], Decimal("100.50"), datetime.datetime(1996, 3, 1 + k % 28), "2-HIGH") for k in [*range(1, 400), 5, 5]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate timestamp_ntz, "
                                  "o_orderpriority string").coalesce(1).write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09}", k % 3, "MACHINERY") for k in range(1, 8)],
                          "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{root}/customer.parquet")
    spark.createDataFrame([(k, f"NATION_{k}") for k in range(3)], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{root}/nation.parquet")
    return root


@pytest.mark.parametrize("rows", [registry.cap, registry.dealt_ev, registry_sources.event_pages])
def test_rows_of_one_row_group_reach_all_cores(spark, tables, rows):
    shares = [len(p) for p in rows(spark, tables).select("seq").rdd.glom().collect()]
    assert sum(shares) == 401 and sum(n > 0 for n in shares) >= spark.sparkContext.defaultParallelism and max(shares) < 100


def test_dealt_rows_are_the_same_rows(spark, tables):
    assert sorted(map(str, registry.dealt_ev(spark, tables).collect())) == sorted(map(str, registry.ev(spark, tables).collect()))
    hot = spark.range(1000).selectExpr("CAST(NULL AS STRING) AS k", "id % 2 AS v").coalesce(1)
    assert max(len(p) for p in spread(hot).rdd.glom().collect()) < 200 and spread(hot).where("v = 1").count() == 500
