"""Positions within a key that do not need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, key: str, moment: str, id_column: str, mark: str) -> DataFrame:
    """Order the rows of each key by (`moment`, `id_column`) and add four columns.

    `position` counts from 1, `previous` is the moment one position before, `marked` is the number of rows whose
    `mark` is not null, and `last_marked` the id of the last of them.

    Every key is numbered in slices of one calendar day, whatever its size: a task holds a key's rows of one day
    and a key's days, never all rows of a key. Counts per slice are combined on the map side; running totals over
    them shift the positions inside the slices.
    """
    cut = df.withColumn("slice", F.to_date(moment))
    place = F.struct(moment, id_column)
    slices = cut.groupBy(key, "slice").agg(
        F.count(F.lit(1)).alias("size"),
        F.count(mark).alias("marks"),
        F.max(moment).alias("latest"),
        F.max(F.when(F.col(mark).isNotNull(), place)).alias("last"),
    )
    by_slice = Window.partitionBy(key).orderBy("slice")
    whole = Window.partitionBy(key)
    shifts = slices.select(
        key,
        "slice",
        (F.sum("size").over(by_slice) - F.col("size")).alias("shift"),
        F.lag("latest").over(by_slice).alias("before"),
        F.sum("marks").over(whole).alias("marked"),
        F.max("last").over(whole)[id_column].alias("last_marked"),
    )
    in_slice = Window.partitionBy(key, "slice").orderBy(moment, id_column)
    numbered = cut.withColumns({"in_slice": F.row_number().over(in_slice), "inside": F.lag(moment).over(in_slice)})
    return numbered.join(shifts, [key, "slice"]).select(
        *df.columns,
        (F.col("in_slice") + F.col("shift")).cast("int").alias("position"),
        F.coalesce("inside", "before").alias("previous"),
        "marked",
        "last_marked",
    )
