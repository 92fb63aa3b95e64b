import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartflow.plans.ordering import number_within


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    days = ["2024-01-01", "2024-01-01", "2024-01-02", "2024-02-10", "2024-03-01"]
    users = [1] * 200 + [2] * 30 + [3, 4, 4, 5]
    data = [(u, rng.choice(days), i * 3, True if rng.random() < 0.6 else None) for i, u in enumerate(users)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "user int, day string, id int, seen boolean").withColumn(
        "day", F.to_timestamp("day")
    )


def numbered(rows):
    kept = ("user", "id", "position", "previous", "marked", "last_marked")
    return sorted(number_within(rows, "user", "moment", "id", mark="seen").select(*kept).collect())


def by_window(rows):
    group = Window.partitionBy("user")
    order = group.orderBy("moment", "id")
    when_marked = F.when(F.col("seen").isNotNull(), F.struct("moment", "id"))
    plain = rows.withColumns(
        {
            "position": F.row_number().over(order),
            "previous": F.lag("moment").over(order),
            "marked": F.count("seen").over(group),
            "last_marked": F.max(when_marked).over(group)["id"],
        }
    )
    return sorted(plain.select("user", "id", "position", "previous", "marked", "last_marked").collect())


@pytest.mark.parametrize("moment", ["day", "day + make_dt_interval(0, id % 24, id % 60)"])
def test_slices_number_like_a_window(rows, moment):
    """Also with times of day, and with equal moments."""
    timed = rows.withColumn("moment", F.expr(moment))
    assert numbered(timed) == by_window(timed)
