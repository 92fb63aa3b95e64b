"""Baskets with the splits of their orders, found without numbering the orders."""

import random

import pytest
from pyspark.sql import functions as F

from cartflow.functions.baskets import items_of_bits, set_bits, set_of
from cartflow.operators import mining, recommend, silver
from cartflow.plans.ordering import number_within
from cartflow.plans.queries import BUILDERS
from cartflow.plans.retail import Retail
from compare import FOLDER


@pytest.fixture(scope="module")
def rows(spark):
    """Users of one order and of many, several on a day; orders without lines, and with lines of unknown items only."""
    rng = random.Random(5)
    users = [1] * 60 + [2] * 9 + [3, 3, 4, 5, 5]
    orders = [(i * 7 % 101, user, f"2024-01-{rng.randint(1, 9):02d}") for i, user in enumerate(users)]
    placed = spark.createDataFrame(orders, "order_id long, user_id long, day string").select(
        "order_id", "user_id", F.to_timestamp("day").alias("placed")
    )
    lines = []
    for n, (order, _, _) in enumerate(orders):
        if n % 6:
            lines += [(order, rng.choice((-2, 11, 60, 61, 62, 130)), True) for _ in range(rng.randint(1, 5))]
        if n % 6 == 1 or n % 6 == 5:
            lines.append((order, None, None))
        elif n % 12 == 0:
            lines.append((order, None, None))
    return placed, spark.createDataFrame(lines, "order_id long, product_id int, known boolean")


def by_numbers(placed, lines):
    """The same from the numbered orders."""
    observed = lines.select("order_id").distinct().withColumn("observed", F.lit(True))
    numbered = number_within(placed.join(observed, "order_id", "left"), "user_id", "placed", "order_id", mark="observed")
    is_last = (F.col("marked") >= 2) & (F.col("order_id") == F.col("last_marked"))
    orders = numbered.select(
        "order_id",
        "user_id",
        F.when(F.col("observed").isNull(), "test").when(is_last, "train").otherwise("prior").alias("eval_set"),
        F.col("position").alias("order_number"),
    )
    return silver.baskets(lines.where("known"), orders), orders


@pytest.mark.parametrize("codes", [None, range(-2, 131), range(-99, 1000)])
def test_splits_equal_those_of_numbered_orders(rows, codes):
    placed, lines = rows
    gathered, items = set_of("product_id"), F.col("items")
    if codes:
        gathered, items = set_bits("product_id", codes), items_of_bits(codes)
    sets = silver.split_sets(lines, placed, gathered)
    split = silver.split_baskets(sets, codes)
    baskets, orders = by_numbers(placed, lines)
    kept = ["order_id", "user_id", "items", "basket_size", "eval_set"]
    expected = baskets.join(orders.select("order_id", "eval_set"), "order_id").select(*kept)
    assert sorted(split.select(*kept).collect()) == sorted(expected.collect())
    assert {r.eval_set for r in expected.collect()} == {"prior", "train"}
    pairs = recommend.eval_contexts(*recommend.target_and_context(sets, items)).select("user_id", "ground_truth", "context_items")
    truth, context = recommend.ground_truth(baskets, orders), recommend.latest_context(baskets, orders)
    expected = recommend.eval_contexts(truth, context).select(*pairs.columns)
    assert sorted(pairs.collect()) == sorted(expected.collect()) != []


def test_baskets_counted_as_bits_are_mined_alike(rows):
    placed, lines = rows
    codes = range(-2, 131)
    sets = silver.split_sets(lines, placed, set_bits("product_id", codes))
    training = silver.prior_baskets(silver.split_baskets(sets, codes), 2)
    counted = silver.counted_baskets(sets, codes, 2)
    assert counted.count() < training.count() == mining.count_baskets(counted)
    mined = [sorted(map(tuple, mining.two_pass_itemsets(df, 0.1).collect())) for df in (training, counted)]
    assert mined[0] == mined[1] != []
    with pytest.raises(ValueError, match="counted"):
        mining.frequent_itemsets(counted, 0.1)


def test_no_item_is_listed(rows):
    placed, lines = rows
    nothing = lines.where("known is null")
    for codes, gathered in ((None, set_of("product_id")), (range(0), set_bits("product_id", range(0)))):
        sets = silver.split_sets(nothing, placed, gathered)
        assert silver.split_baskets(sets, codes).collect() == []
        if codes is not None:
            assert silver.counted_baskets(sets, codes, 2).collect() == []


@pytest.mark.parametrize(
    "name", ["frequent_itemsets", "invalid_itemsets", "rule_names", "best_rule_per_product", "coverage_hits", "selection_score"]
)
def test_rules_and_matches_number_no_order(spark, monkeypatch, name):
    """The numbering was about half of the time of these queries on large tables."""

    def refuse(self):
        raise AssertionError("orders are numbered")

    monkeypatch.setattr(Retail, "orders", property(refuse))
    assert BUILDERS[name](Retail(spark, FOLDER)).count() > 0
