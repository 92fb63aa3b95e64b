"""Deterministic sampling by key buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000


def bucket_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key falls in the first `fraction` of 10 000 buckets; equal keys stay together."""
    chosen = round(fraction * BUCKETS)
    if not 1 <= chosen <= BUCKETS:
        raise ValueError(f"a share of {fraction} does not fill 1 to {BUCKETS} buckets")
    return df.where(F.pmod(F.col(key), F.lit(BUCKETS)) < chosen)
