"""The same comparisons where one order, one product and one user hold about a third of all rows."""

import os

import duckdb
import pytest

from cartflow.plans.oracle import oracle
from cartflow.plans.queries import BUILDERS
from cartflow.plans.retail import Retail
from compare import TABLES, connect, differences

FOLDER = "/root/testdata/sf0.01"

CHANGES = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 12 ELSE l_orderkey END AS l_orderkey,"
    " CASE WHEN l_suppkey % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey)",
}
CHECKED = [
    "shop_orders",
    "order_items",
    "baskets",
    "top_products",
    "reorder_by_department",
    "kpi_summary",
    "duplicate_profile",
    "orphan_count",
    "frequent_itemsets",
    "eval_contexts",
    "recommend_topk",
    "coverage_hits",
    "serve_baskets",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for name in TABLES:
        source = f"FROM '{FOLDER}/{name}.parquet'"
        con.execute(f"COPY ({CHANGES.get(name, 'SELECT *')} {source}) TO '{os.path.join(folder, name)}.parquet'")
    return folder


@pytest.fixture(scope="module")
def results(spark, skewed):
    return Retail(spark, skewed), connect(skewed), oracle()


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql_under_skew(name, results):
    retail, duck, sql = results
    assert differences(BUILDERS[name](retail), sql[name], duck) == []
