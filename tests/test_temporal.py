"""As-of and interval joins and differences of versions against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from cartflow.operators import changes, temporal

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def sides(spark):
    """Few users, one of them with most rows; equal moments, days without rows of one side, null keys and moments."""
    rng = random.Random(2)
    moment = lambda: START + timedelta(hours=rng.randint(0, 24 * 20))
    user = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, user(), moment() if i % 17 else None) for i in range(300)]
    right = [(i, user(), moment() if i % 13 else None) for i in range(120)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, user int, {name}_at timestamp_ntz")
    return left, right, frame(left, "l"), frame(right, "r")


def test_asof(sides):
    left, right, l_frame, r_frame = sides
    expected = {}
    for i, user, at in left:
        fits = [(when, j) for j, other, when in right if None not in (user, at, when) and other == user and when <= at]
        expected[i] = max(fits)[1] if fits else None
    found = temporal.asof_join(l_frame, r_frame, "user", "l_at", "r_at", ["r"])
    assert found.columns == ["l", "user", "l_at", "r"]
    rows = found.collect()
    assert {x.l: x.r for x in rows} == expected and len(rows) == 300
    assert temporal.asof_join(l_frame, r_frame.limit(0), "user", "l_at", "r_at", ["r"]).where("r IS NOT NULL").count() == 0


@pytest.mark.parametrize("days", [1, 3])
def test_intervals(sides, days):
    left, right, l_frame, r_frame = sides
    expected = {
        (i, j)
        for i, user, at in left
        for j, other, when in right
        if None not in (user, at, when) and user == other and at <= when < at + timedelta(days=days)
    }
    rows = temporal.interval_join(l_frame, r_frame, "user", "l_at", "r_at", days).collect()
    assert {(x.l, x.r) for x in rows} == expected and len(rows) == len(expected) > 100


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "d"), (None, "e")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, "f"), (None, "e"), (None, "e")], "k int, v string")
    rows = {tuple(r) for r in changes.row_changes(old, new).collect()}
    assert rows == {(1, "a", -1), (2, "b", -1), (2, "c", 1), (4, "d", -1), (5, "f", 1), (None, "e", 1)}
    keys = {tuple(r) for r in changes.key_changes(old, new, ["k"]).collect()}
    assert keys == {(1, "removed"), (2, "changed"), (4, "removed"), (5, "added"), (None, "added")}
    assert changes.row_changes(old, old).count() == 0
