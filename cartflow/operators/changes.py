"""Differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that one version has more often than the other, with `times`: positive where the new one has more.

    One grouping over both versions with map-side combine; equal rows, nulls included, count as often as they occur.
    """
    columns = old.columns
    signed = lambda df, n: df.select(*columns, F.lit(n).alias("__n"))
    counted = signed(old, -1).unionByName(signed(new, 1)).groupBy(*columns).agg(F.sum("__n").alias("times"))
    return counted.where(F.col("times") != 0)


def key_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows differ: `added`, `removed` or `changed`.

    Only the rows that differ are grouped by key, and a key is one row of two sums.
    """
    moved = row_changes(old, new)
    sums = moved.groupBy(*keys).agg(F.min("times").alias("low"), F.max("times").alias("high"))
    change = F.when(F.col("low") > 0, "added").when(F.col("high") < 0, "removed").otherwise("changed")
    return sums.select(*keys, change.alias("change"))
