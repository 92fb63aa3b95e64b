"""Exact percentiles against the built-in aggregate, through several passes."""

import random

import pytest
from pyspark.sql import functions as F

from cartflow.operators.quantiles import exact_percentile


@pytest.fixture(scope="module")
def values(spark):
    """Groups of one value, of two, of equal ones, of an even and an odd number, very uneven, and negative."""
    rng = random.Random(5)
    groups = {
        "one": [2.5],
        "two": [1.0, 2.0],
        "equal": [7.0] * 500,
        "even": [rng.random() for _ in range(1_000)],
        "odd": [rng.choice([0.1, 0.2, 0.3]) for _ in range(999)],
        "uneven": [rng.random() * 1e-9 for _ in range(800)] + [1e12],
        "negative": [rng.gauss(0, 1) for _ in range(777)],
        "none": [None] * 5,
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [(None, 4.0), (None, None)]
    return spark.createDataFrame(rows, "k string, x double").repartition(4)


@pytest.mark.parametrize("fraction", [0.5, 0.0, 1.0, 0.333])
@pytest.mark.parametrize("bins, small", [(512, 4_096), (4, 3), (2, 1)])
def test_equal_to_the_aggregate(values, fraction, bins, small):
    if small == 1 and fraction != 0.5:
        pytest.skip("the passes are the same")
    grouped = values.where("k IS NOT NULL").groupBy("k").agg(F.percentile("x", fraction).alias("x")).where("x IS NOT NULL")
    expected = {r.k: r.x for r in grouped.collect()}
    found = exact_percentile(values.where("k IS NOT NULL"), ["k"], "x", fraction, bins, small).collect()
    assert {r.k: r.x for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("small", [4_096, 5])
def test_one_group(values, small):
    expected = values.agg(F.percentile("x", 0.5)).first()[0]
    assert [r.x for r in exact_percentile(values, [], "x", bins=8, small=small).collect()] == [expected]


def test_no_values(values):
    assert exact_percentile(values.limit(0), ["k"], "x").count() == 0
    assert exact_percentile(values.where("k = 'none'"), ["k"], "x").count() == 0


def test_no_group_is_held_in_one_buffer(values):
    plan = exact_percentile(values, ["k"], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
