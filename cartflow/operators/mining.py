"""Frequent itemsets and association rules.

MLlib mines the itemsets, or two passes over partitions do where the support is low; they are stored once, and everything
after that is joins over the stored table.
A grid of support and confidence levels needs one fit at the lowest support: the itemsets and rules of the
higher levels are subsets with the same metrics.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cartflow.functions.baskets import config_id, overlaps, rule_id, rule_label
from cartflow.operators.frames import beside, stack
from cartflow.operators.partition_mining import partition_itemsets
from cartflow.operators.quality import invalid_baskets
from cartflow.operators.quantiles import exact_percentile
from cartflow.session import materialize

# The sizes that `growth_report` compares a fit with, and the training basket size.
MAX_ITEMSETS = 200_000
MAX_RULES = 500_000
MIN_BASKET_SIZE = 2


class GrowthLimitExceeded(ValueError):
    """A fit produced more itemsets or rules than the caller allows. The run stops; nothing is cut or skipped."""


@dataclass(frozen=True)
class Grid:
    """Support levels crossed with confidence levels."""

    supports: tuple[float, ...]
    confidences: tuple[float, ...]

    @property
    def cells(self) -> list[tuple[str, float, float]]:
        return [(config_id(s, c), s, c) for s in sorted(self.supports) for c in sorted(self.confidences)]


def min_count(min_support: float, baskets: int) -> int:
    """The basket count that the miner demands for a support level."""
    return math.ceil(min_support * baskets)


def training_baskets(
    baskets: DataFrame, orders: DataFrame, min_size: int = MIN_BASKET_SIZE, partitions: int | None = None
) -> DataFrame:
    """The prior baskets with at least `min_size` items."""
    prior = orders.where(F.col("eval_set") == "prior").select("order_id")
    chosen = (
        baskets.where(F.size("items") >= min_size).join(prior, "order_id").select("order_id", "user_id", "items")
    )
    return chosen.repartition(partitions) if partitions else chosen


def training_report(baskets: DataFrame, orders: DataFrame, min_size: int = MIN_BASKET_SIZE) -> DataFrame:
    """How many baskets there are, are prior, and are kept: one row."""
    prior = orders.where(F.col("eval_set") == "prior").select("order_id", F.lit(True).alias("is_prior"))
    is_prior, large = F.col("is_prior"), F.size("items") >= min_size
    return (
        baskets.join(prior, "order_id", "left")
        .agg(
            F.count(F.lit(1)).alias("source_baskets"),
            F.count_if(is_prior).alias("prior_baskets"),
            F.count_if(is_prior & large).alias("training_baskets"),
        )
        .withColumn("excluded_baskets", F.col("prior_baskets") - F.col("training_baskets"))
    )


def count_baskets(training: DataFrame) -> int:
    """The rows, or the sum of `n` where a row stands for `n` equal baskets."""
    if "n" not in training.columns:
        return training.count()
    return training.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def checked_training(training: DataFrame, min_size: int = MIN_BASKET_SIZE) -> DataFrame:
    """Refuse an empty or malformed training table."""
    faults = beside(
        training.agg(F.count(F.lit(1)).alias("rows")),
        invalid_baskets(training, min_size).agg(F.count(F.lit(1)).alias("invalid")),
    ).first()
    if not faults["rows"] or faults["invalid"]:
        raise ValueError(f"{faults['rows']} training baskets, {faults['invalid']} of them invalid")
    return training


def stored_within(df: DataFrame, limit: int | None, what: str) -> DataFrame:
    """Store `df` as all its tasks write it, and count it on the way; more than `limit` rows are an error."""
    written = Observation(what)
    stored = materialize(df.observe(written, F.count(F.lit(1)).alias("rows")), what)
    if limit is not None and written.get["rows"] > limit:
        raise GrowthLimitExceeded(f"{written.get['rows']} {what}, {limit} allowed")
    return stored


def frequent_itemsets(
    training: DataFrame, min_support: float, cap: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Itemsets in at least `min_support` of the baskets: `(items, freq)`, items ascending."""
    if "n" in training.columns:
        raise ValueError("MLlib counts rows; counted baskets are for two_pass_itemsets")
    miner = FPGrowth(itemsCol="items", minSupport=min_support)
    if partitions:
        miner = miner.setNumPartitions(partitions)
    found = miner.fit(training.select("items")).freqItemsets
    return stored_within(found.select(F.sort_array("items").alias("items"), "freq"), cap, "itemsets")


def two_pass_itemsets(
    training: DataFrame, min_support: float, cap: int | None = None, partitions: int | None = None
) -> DataFrame:
    """The same as `frequent_itemsets`, mined partition by partition: memory does not grow as the support falls.

    `training` may be counted already: `n` tells how many baskets a row stands for.
    """
    baskets = count_baskets(training)
    found = partition_itemsets(training, min_count(min_support, baskets), baskets, partitions)
    return stored_within(found, cap, "itemsets")


Miner = Callable[[DataFrame, float, int | None, int | None], DataFrame]


def growth_report(
    itemsets: DataFrame, rules: DataFrame, max_itemsets: int = MAX_ITEMSETS, max_rules: int = MAX_RULES
) -> DataFrame:
    """The size of a fit against its limits: `(result, n, cap, within)`."""
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("result"), "n", F.lit(cap).cast("long").alias("cap"), (F.col("n") <= cap).alias("within")
        )
        for name, df, cap in (("itemsets", itemsets, max_itemsets), ("rules", rules, max_rules))
    ]
    return stack(sizes)


def association_rules(
    itemsets: DataFrame, baskets: int, min_confidence: float = 0.0, min_support: float = 0.0
) -> DataFrame:
    """Rules with one consequent: `(antecedent, consequent, confidence, lift, support, freq)`.

    Every part of a frequent itemset is itself in the table, so both lookups are equi-joins that always match.
    """
    parts = itemsets.where((F.size("items") > 1) & (F.col("freq") >= min_count(min_support, baskets))).select(
        "items", "freq", F.explode("items").alias("item")
    )
    sides = parts.select(
        F.filter("items", lambda other: other != F.col("item")).alias("antecedent"), "item", "freq"
    )
    antecedents = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("antecedent_freq"))
    singles = itemsets.where(F.size("items") == 1).select(
        F.element_at("items", 1).alias("item"), F.col("freq").alias("item_freq")
    )
    confidence = F.col("freq") / F.col("antecedent_freq")
    return (
        sides.join(antecedents, "antecedent")
        .where(confidence >= min_confidence)
        .join(singles, "item")
        .select(
            "antecedent",
            F.array("item").alias("consequent"),
            confidence.alias("confidence"),
            (confidence / (F.col("item_freq") / F.lit(float(baskets)))).alias("lift"),
            (F.col("freq") / F.lit(float(baskets))).alias("support"),
            "freq",
        )
    )


def is_useful() -> Column:
    """Positive association between a non-empty antecedent and one item outside it."""
    return (
        (F.col("lift") > 1)
        & (F.size("antecedent") >= 1)
        & (F.size("consequent") == 1)
        & ~overlaps("antecedent", "consequent")
    )


def useful_rules(rules: DataFrame, min_confidence: float) -> DataFrame:
    """The useful rules with sorted sides, one per pair of sides, and their id."""
    kept = rules.where((F.col("confidence") >= min_confidence) & is_useful())
    ordered = kept.withColumns({side: F.sort_array(side) for side in ("antecedent", "consequent")})
    return ordered.dropDuplicates(["antecedent", "consequent"]).withColumn("rule_id", rule_id())


METRICS = ("association_rules", "avg_support", "avg_confidence", "avg_lift", "median_lift", "rules_lift_gt_1")


def _metrics() -> list[Column]:
    return [
        F.count("lift").alias("association_rules"),
        F.avg("support").alias("avg_support"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("lift").alias("avg_lift"),
        F.count_if(F.col("lift") > 1).alias("rules_lift_gt_1"),
    ]


def rule_metrics(rules: DataFrame) -> DataFrame:
    """Number, mean support, confidence and lift, exact median lift, and rules with lift above 1: one row."""
    return beside(rules.agg(*_metrics()), median_lift(rules, [])).select(*METRICS)


def median_lift(rules: DataFrame, keys: list[str]) -> DataFrame:
    return exact_percentile(rules, keys, "lift").withColumnRenamed("lift", "median_lift")


def _cells(rules: DataFrame, grid: Grid, baskets: int) -> DataFrame:
    """Each rule once per grid cell whose thresholds it meets; the rules are read once for the whole grid."""
    cells = [
        F.when(
            (F.col("freq") >= min_count(support, baskets)) & (F.col("confidence") >= confidence), F.lit(name)
        )
        for name, support, confidence in grid.cells
    ]
    return rules.withColumn("config_id", F.explode(F.array_compact(F.array(*cells))))


def grid_frame(rules: DataFrame, grid: Grid, baskets: int) -> DataFrame:
    """The grid as a table `(config_id, min_support, min_confidence, min_count)`."""
    rows = [(name, s, c, min_count(s, baskets)) for name, s, c in grid.cells]
    return rules.sparkSession.createDataFrame(
        rows, "config_id string, min_support double, min_confidence double, min_count bigint"
    )


def grid_metrics(itemsets: DataFrame, rules: DataFrame, grid: Grid, baskets: int) -> DataFrame:
    """Metrics of every grid cell over its rules, with its numbers of itemsets and useful rules.

    A cell without rules keeps its row: counts 0 and no averages. `rules` holds the rules of the lowest
    levels with their `freq`.
    """
    in_cells = _cells(rules, grid, baskets)
    per_cell = in_cells.groupBy("config_id").agg(*_metrics(), F.count_if(is_useful()).alias("useful_rules"))
    medians = median_lift(in_cells, ["config_id"])
    levels = [
        F.when(F.col("freq") >= min_count(s, baskets), F.lit(s)) for s in sorted(grid.supports)
    ]
    per_level = (
        itemsets.select(F.explode(F.array_compact(F.array(*levels))).alias("min_support"))
        .groupBy("min_support")
        .agg(F.count(F.lit(1)).alias("frequent_itemsets"))
    )
    counts = ["frequent_itemsets", "association_rules", "rules_lift_gt_1", "useful_rules"]
    return (
        grid_frame(rules, grid, baskets)
        .drop("min_count")
        .join(per_level, "min_support", "left")
        .join(per_cell, "config_id", "left")
        .join(medians, "config_id", "left")
        .withColumn("training_baskets", F.lit(baskets).cast("long"))
        .fillna(0, subset=counts)
    )


def config_rules(rules: DataFrame, grid: Grid, baskets: int) -> DataFrame:
    """The useful rules of every grid cell. A rule id recurs across cells: only with `config_id` is it a key."""
    useful = useful_rules(rules, min(grid.confidences))
    return _cells(useful, grid, baskets)


@dataclass
class MinedGrid:
    """Itemsets and rules of the lowest support of `grid`; those of the higher levels are among them."""

    training: DataFrame
    baskets: int
    grid: Grid
    itemsets: DataFrame
    rules: DataFrame
    fit_seconds: float

    def metrics(self) -> DataFrame:
        """`grid_metrics` plus `status` and `fit_seconds`, which all cells of the fit share."""
        return grid_metrics(self.itemsets, self.rules, self.grid, self.baskets).withColumns(
            {"status": F.lit("PASS"), "fit_seconds": F.lit(self.fit_seconds)}
        )

    def config_rules(self) -> DataFrame:
        return config_rules(self.rules, self.grid, self.baskets)

    def cell_rules(self, min_support: float, min_confidence: float) -> DataFrame:
        """The rules of one cell, which must belong to the mined grid."""
        if min_support not in self.grid.supports or min_confidence not in self.grid.confidences:
            raise ValueError(f"{config_id(min_support, min_confidence)} was not mined")
        return association_rules(self.itemsets, self.baskets, min_confidence, min_support)


def mine_grid(
    training: DataFrame,
    grid: Grid,
    max_itemsets: int | None = None,
    max_rules: int | None = None,
    partitions: int | None = None,
    miner: Miner = frequent_itemsets,
) -> MinedGrid:
    """One fit at the lowest support, which serves all levels. Any failure ends the run.

    `training` should be a stored table, since the miner reads it several times.
    """
    baskets = count_baskets(training)
    started = time.perf_counter()
    itemsets = miner(training, min(grid.supports), max_itemsets, partitions)
    rules = stored_within(association_rules(itemsets, baskets, min(grid.confidences)), max_rules, "rules")
    return MinedGrid(training, baskets, grid, itemsets, rules, time.perf_counter() - started)


def rule_names(rules: DataFrame, names: DataFrame, item: str = "product_id", name: str = "product_name") -> DataFrame:
    """Add `antecedent_names` and `consequent_names` in the order of the ids.

    Both sides share one join and one grouping; the groups are as long as a rule.
    """
    keys = [c for c in rules.columns]
    parts = rules.select("*", F.posexplode(F.concat("antecedent", "consequent")).alias("pos", item))
    named = (
        parts.join(names.select(item, name), item)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", name))).alias("named"))
    )

    def side(is_left: bool) -> Column:
        length = F.size("antecedent")
        chosen = F.filter("named", lambda p: (p["pos"] < length) if is_left else (p["pos"] >= length))
        return F.transform(chosen, lambda p: p[name])

    return named.select(*keys, side(True).alias("antecedent_names"), side(False).alias("consequent_names"))


def _power_of_two(exponent: Column) -> Column:
    """2 to the exponent as text, whole numbers without a decimal point."""
    return F.regexp_replace(F.pow(F.lit(2.0), exponent).cast("string"), r"\.0$", "")


def lift_histogram(rules: DataFrame) -> DataFrame:
    """Rules per power-of-two interval of lift: `(lift_bin, interval, count)`."""
    exponent = F.col("lift_bin")
    interval = F.format_string("[%s, %s)", _power_of_two(exponent), _power_of_two(exponent + 1))
    return (
        rules.groupBy(F.floor(F.log2("lift")).cast("int").alias("lift_bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("lift_bin", interval.alias("interval"), "count")
        .orderBy("lift_bin")
    )


def confidence_lift_density(rules: DataFrame) -> DataFrame:
    """Rules per cell of width 0.05 in confidence and a quarter power of two in lift."""
    return (
        rules.groupBy(
            (F.floor(F.col("confidence") * 20) / 20).alias("confidence_bin"),
            (F.floor(F.log2("lift") * 4) / 4).alias("log2_lift_bin"),
        )
        .agg(F.count(F.lit(1)).alias("rule_count"))
        .withColumn("lift_bin", F.pow(F.lit(2.0), F.col("log2_lift_bin")))
        .orderBy("confidence_bin", "log2_lift_bin")
    )


def _by_lift() -> list[Column]:
    return [F.desc("lift"), F.desc("support"), F.asc("rule_id")]


def top_rules(rules: DataFrame, min_support: float = 0.001, n: int = 20) -> DataFrame:
    """The `n` named rules of highest lift with their rank and a numbered label."""
    top = rules.where(F.col("support") >= min_support).orderBy(*_by_lift()).limit(n)
    # The window sees only the n rows of the report.
    rank = F.row_number().over(Window.orderBy(*_by_lift()))
    return top.withColumn("rank", rank).withColumn(
        "label", F.concat(F.col("rank").cast("string"), F.lit(". "), rule_label())
    )


def filter_rules(
    rules: DataFrame, min_support: float = 0.001, min_confidence: float = 0.20, min_lift: float = 1.0
) -> DataFrame:
    """Named rules at or above all three thresholds, strongest lift first: `(label, support, ...)`."""
    kept = (
        (F.col("support") >= min_support)
        & (F.col("confidence") >= min_confidence)
        & (F.col("lift") >= min_lift)
    )
    return rules.where(kept).orderBy(*_by_lift()).select(
        rule_label().alias("label"), "support", "confidence", "lift", "rule_id"
    )
