"""Every registered query against its SQL counterpart, on the smallest test tables."""

import pytest

from cartflow.plans.oracle import oracle
from cartflow.plans.queries import BUILDERS
from compare import FOLDER, connect, differences

ORACLE = oracle()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert BUILDERS.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", list(BUILDERS))
def test_query_matches_sql(name, retail, duck):
    df = BUILDERS[name](retail)
    assert differences(df, ORACLE[name], duck) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert unwanted not in plan


def test_split_filters_reach_the_files(retail):
    """The splits are separated at the scan, which reads only the columns it needs."""
    from cartflow.operators import recommend

    plan = recommend.latest_context(retail.stored_baskets, retail.stored_orders)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(eval_set,prior)" in text
    assert "ReadSchema: struct<order_id:bigint,eval_set:string,order_number:int>" in text


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 9
    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys() >= BUILDERS.keys()


def test_rule_queries_build_only_their_tables(spark, monkeypatch):
    from cartflow.plans import retail as module

    stored = []
    monkeypatch.setattr(module, "materialize", lambda df, name: stored.append(name) or df)
    for name in ("rule_between", "rule_nonblank"):
        BUILDERS[name](module.Retail(spark, FOLDER)).collect()
    assert "lines" not in stored and "items" not in stored
