"""Queries whose SQL differed at other table sizes than those of `test_queries`."""

import pytest

from cartflow.plans.oracle import oracle
from cartflow.plans.queries import BUILDERS
from cartflow.plans.retail import Retail
from compare import FOLDER, connect, differences

ORACLE = oracle()


@pytest.fixture
def small_shop(tmp_path):
    """A folder and a connection over `orders`, `lineitem` and `part`, the first two by the caller's SQL."""

    def make(orders: str, lines: str):
        con = connect(FOLDER)
        for name, body in (("orders", orders), ("lineitem", lines), ("part", "SELECT * FROM part")):
            path = tmp_path / f"{name}.parquet"
            con.execute(f"COPY ({body}) TO '{path}' (FORMAT parquet)")
        for name in ("orders", "lineitem", "part"):
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return make


def test_lookup_without_rules(spark, small_shop):
    """No basket is large enough for a rule."""
    folder, con = small_shop(
        "SELECT * REPLACE (o_orderkey % 5 AS o_custkey) FROM orders WHERE o_orderkey <= 30",
        "SELECT * REPLACE (1 + l_linenumber AS l_partkey) FROM lineitem WHERE l_orderkey <= 30 AND l_linenumber < 2",
    )
    assert differences(BUILDERS["invalid_lookup"](Retail(spark, folder)), ORACLE["invalid_lookup"], con) == []
    assert {n for _, n in con.execute(ORACLE["invalid_lookup"]).fetchall()} == {0}


def test_product_floor_is_rounded_up(spark, small_shop):
    """80,001 training baskets ask for five baskets of an itemset: products 3 and 4 have them, 1 and 2 are in four."""
    day = "TIMESTAMP '2020-01-01' + INTERVAL 1 HOUR * CAST(i AS INTEGER) AS o_orderdate"
    folder, con = small_shop(
        f"SELECT i + 1 AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, {day} FROM range(80002) r(i)",
        """SELECT i + 1 AS l_orderkey, CASE WHEN i < 4 THEN j WHEN i < 9 THEN j + 2 ELSE 2 * i + j END AS l_partkey,
            CAST(j AS INTEGER) AS l_linenumber FROM range(80002) r(i), range(1, 3) s(j)""",
    )
    assert differences(BUILDERS["product_itemsets"](Retail(spark, folder)), ORACLE["product_itemsets"], con) == []
    assert con.execute(f"SELECT min(freq), count(*) FROM ({ORACLE['product_itemsets']})").fetchall() == [(5, 3)]
