"""Merged sketches against exact distinct counts."""

from pyspark.sql import functions as F

from cartflow.operators import sketches
from cartflow.session import materialize


def test_sketches_merge_at_any_level(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 11 > 0, F.col("id") % 9_001).alias("x")
    )
    stored = materialize(sketches.distinct_sketches(rows, ["a", "b"], "x"), "sketches")
    assert stored.count() == 21
    for keys in (["a", "b"], ["a"], ["b"], []):
        merged = sketches.merged_distinct(stored, keys)
        assert merged.agg(F.sum("n")).first()[0] == 60_000
    errors = sketches.estimate_errors(stored, rows, ["a"], "x").collect()
    assert len(errors) == 3 and all(r.error < 0.08 for r in errors)
    small = rows.where("x < 20")
    few = sketches.estimate_errors(sketches.distinct_sketches(small, ["a"], "x"), small, ["a"], "x").collect()
    assert all(r.error == 0 for r in few)
    assert sketches.merged_distinct(stored.limit(0), ["a"]).count() == 0
