"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def beside(*one_row: DataFrame) -> DataFrame:
    """Put one-row frames with distinct columns next to each other, without a cross join."""
    stacked = stack(list(one_row))
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def unpivot_counts(wide: DataFrame, entries: list[tuple[tuple[str, ...], Column]], labels: list[str]) -> DataFrame:
    """One row per entry: its labels and the count it takes from the one-row frame `wide`."""
    rows = [
        F.struct(*[F.lit(text).alias(label) for label, text in zip(labels, texts)], value.cast("long").alias("n"))
        for texts, value in entries
    ]
    return wide.select(F.inline(F.array(*rows)))
