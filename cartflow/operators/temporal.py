"""Joins of two tables by a key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each row of `left` with `values` of the last row of `right` of its key at or before its moment, or nulls.

    Equal moments go to the larger values. Both sides are cut into slices of a key's calendar days: a task orders one
    such slice, and what the days before leave over is a running last over the days of a key. No task holds all rows of
    a key. A null key or moment meets nothing.
    """
    kept = [c for c in left.columns]
    met = F.struct(F.col(right_at).alias("__at"), *values)
    rows = left.select(*kept, F.to_date(at).alias("__day"), F.col(at).alias("__when"), F.lit(1).alias("__side"))
    others = right.where(F.col(right_at).isNotNull()).select(
        key, F.to_date(right_at).alias("__day"), F.col(right_at).alias("__when"), F.lit(0).alias("__side"), met.alias("__met")
    )
    both = rows.unionByName(others, allowMissingColumns=True)
    # Rows of the right side stand before those of the left side of the same moment.
    inside = Window.partitionBy(key, "__day").orderBy("__when", "__side", "__met").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("__own", F.last("__met", ignorenulls=True).over(inside)).where("__side = 1")
    slices = both.groupBy(key, "__day").agg(F.max("__met").alias("__last"))
    days = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(key, "__day", F.last("__last", ignorenulls=True).over(days).alias("__before"))
    joined = placed.drop("__met").join(carried, [key, "__day"], "left")
    known = F.col(key).isNotNull() & F.col("__when").isNotNull()
    found = F.when(known, F.coalesce("__own", "__before"))
    return joined.select(*kept, *[found[v].alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, days: int) -> DataFrame:
    """Pairs of rows of one key where the right moment is less than `days` days after the left one, or equal to it.

    Time is cut into bins of that length; a left row goes to its bin and the next one, so that a pair meets in one bin.
    That is an equality join on key and bin, whose large bins adaptive execution splits.
    """
    seconds = days * 86_400
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    near = left.withColumn("__bin", F.explode(F.array(bin_of(at), bin_of(at) + 1)))
    far = right.withColumn("__bin", bin_of(right_at))
    pairs = near.join(far, [key, "__bin"])
    after = (F.col(right_at) >= F.col(at)) & (F.col(right_at) < F.col(at) + F.make_dt_interval(F.lit(days)))
    return pairs.where(after).drop("__bin")
