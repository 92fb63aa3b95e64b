"""Exact percentiles of large groups without a buffer that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartflow.session import materialize

BINS = 512
# A range with so few values is sorted in one buffer.
SMALL = 4_096


def exact_percentile(
    df: DataFrame, keys: list[str], value: str, fraction: float = 0.5, bins: int = BINS, small: int = SMALL
) -> DataFrame:
    """The keys and `value` at `fraction` of each group, between its two nearest values where it falls between them.

    Each pass counts the values per bin of the range that must hold the wanted place and goes on with the smallest and
    largest value of its bin, for all groups at once; it ends when a range holds few values, or only one. A pass is an
    aggregate with at most `bins` rows per group. Values must be finite; nulls are left out, and so are groups without values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    named = list(keys)
    if not keys:
        # One group: a key that the optimizer does not take for a constant, so that the ranges are met by a hash join.
        keys, rows = ["whole"], rows.withColumn("whole", F.pmod(F.hash("x"), F.lit(1)))
    group = [F.col(k) for k in keys]
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("n > 0")
    at = (F.col("n") - 1) * F.lit(fraction)
    places = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    # low .. high holds `inside` values, of which the first has the place `before`.
    start = totals.select(
        *keys, at.alias("at"), F.explode(places).alias("place"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")
    )
    state = materialize(start, "places")

    def within(ranges: DataFrame) -> DataFrame:
        held = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
        # A row or two per group; the values need not be shuffled while the ranges are small enough to be sent along.
        return rows.join(ranges, keys).where(held)

    while True:
        wide = (F.col("inside") > small) & (F.col("low") < F.col("high"))
        ranges = state.where(wide)
        if ranges.isEmpty():
            break
        bin = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = (
            within(ranges)
            .groupBy(*keys, "at", "place", "before", bin.alias("bin"))
            .agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        running = Window.partitionBy(*keys, "place").orderBy("bin")
        ahead = F.col("before") + F.sum("inside").over(running) - F.col("inside")
        narrowed = counted.withColumn("before", ahead).where("place >= before AND place < before + inside").drop("bin")
        state = materialize(narrowed.select(state.columns).unionByName(state.where(~wide)), "places")

    few = within(state.where("low < high")).groupBy(*keys, "at", "place", "before").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    found = few.select(*keys, "at", "place", F.get("xs", (F.col("place") - F.col("before")).cast("int")).alias("x"))
    found = found.unionByName(state.where("low = high").select(*keys, "at", "place", F.col("low").alias("x")))
    both = found.groupBy(*keys, "at").agg(F.min_by("x", "place").alias("a"), F.max_by("x", "place").alias("b"))
    lower = F.floor("at").cast("double")
    between = (lower + 1 - F.col("at")) * F.col("a") + (F.col("at") - lower) * F.col("b")
    return both.select(*named, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias(value))
