"""Row predicates of the data-quality rules. Each column is true where the row violates the rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_positive(name: str, min_value: int = 1) -> Column:
    """Keys and counters start at `min_value`."""
    return F.col(name) < min_value


def outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def not_in(name: str, values) -> Column:
    return ~F.col(name).isin(*values)


def outside_or_nan(name: str, low: float, high: float) -> Column:
    return outside(name, low, high) | F.isnan(name)


def blank(name: str) -> Column:
    return F.length(F.trim(F.col(name))) == 0


def gap_mismatch(position: str, gap: str) -> Column:
    """The first order of a user has no gap, every later one has."""
    first, later = F.col(position) == 1, F.col(position) > 1
    return (first & F.col(gap).isNotNull()) | (later & F.col(gap).isNull())


def count_when(condition: Column) -> Column:
    """Rows where `condition` holds; unknown counts as no, and no rows give 0."""
    return F.count_if(condition)
