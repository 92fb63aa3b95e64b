"""Streams over arriving files against the same aggregates of all rows."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartflow.streaming import events

START = datetime(2024, 5, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.fixture
def arrive(spark, tmp_path):
    """Writes rows (hours after START, user, type) as one more file of the folder."""
    number = iter(range(1_000_000))

    def add(*rows):
        made = [(next(number), START + timedelta(hours=h), user, kind, float(h)) for h, user, kind in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return str(tmp_path / "in"), add


def totals(df):
    rows = df.select(F.date_format("starts", "dd").alias("day"), "event_type", "n", "total").collect()
    return {(r.day, r.event_type): (r.n, r.total) for r in rows}


def run(spark, folder, root):
    stream = events.windowed_totals(events.event_stream(spark, folder, 1))
    return events.run_available(stream, f"{root}/out", f"{root}/progress")


def test_runs_go_on_where_the_last_one_ended_and_count_late_rows(spark, arrive, tmp_path):
    folder, add = arrive
    add((1, 1, "view"), (2, 1, "view"), (30, 2, "buy"))
    run(spark, folder, tmp_path)
    found = lambda: totals(events.latest(spark, f"{tmp_path}/out", ["starts", "event_type"]))
    assert found() == {("01", "view"): (2, 3.0), ("02", "buy"): (1, 30.0)}
    add((3, 1, "view"), (100, 3, "view"))  # in time: the watermark is at 30 - 24 hours, the window ends at 24
    run(spark, folder, tmp_path)
    assert found() == {("01", "view"): (3, 6.0), ("02", "buy"): (1, 30.0), ("05", "view"): (1, 100.0)}
    add((4, 1, "view"), (5, 1, "buy"), (101, 1, "view"))  # two come after the watermark has passed their windows
    run(spark, folder, tmp_path)
    assert found() == {("01", "view"): (3, 6.0), ("02", "buy"): (1, 30.0), ("05", "view"): (2, 201.0)}
    counts = events.late_rows(spark.read.parquet(folder), events.latest(spark, f"{tmp_path}/out", ["starts", "event_type"]))
    assert counts.first().asDict() == {"arrived": 8, "counted": 6, "late": 2}
    # Nothing new: nothing changes.
    run(spark, folder, tmp_path)
    assert found()["05", "view"] == (2, 201.0)


def test_a_replayed_batch_changes_nothing(spark, arrive, tmp_path):
    folder, add = arrive
    for hour in range(0, 60, 10):
        add((hour, 1, "view"), (hour + 1, 2, "buy"))
    last = run(spark, folder, tmp_path)
    keys = ["starts", "event_type"]
    before, rows = totals(events.latest(spark, f"{tmp_path}/out", keys)), events.written(spark, f"{tmp_path}/out").count()
    assert sum(n for n, _ in before.values()) == 12
    # As after a crash between the write and its record: the last batch runs again.
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/progress/commits/{name}"):
            os.remove(f"{tmp_path}/progress/commits/{name}")
    run(spark, folder, tmp_path)
    assert totals(events.latest(spark, f"{tmp_path}/out", keys)) == before
    assert events.written(spark, f"{tmp_path}/out").count() >= rows


def test_sessions_close_after_their_gap(spark, arrive, tmp_path):
    folder, add = arrive

    def go():
        found = events.sessions(events.event_stream(spark, folder, 1), "2 hours", "3 hours")
        events.run_available(found, f"{tmp_path}/out", f"{tmp_path}/progress", "append")
        rows = events.written(spark, f"{tmp_path}/out").collect()
        return sorted((r.user_id, (r.starts - START).total_seconds() / 3600, (r.ends - START).total_seconds() / 3600, r.n) for r in rows)

    add((1, 1, "view"), (2, 1, "view"), (2, None, "view"), (2.5, 2, "view"))
    assert go() == []
    add((3.5, 1, "buy"), (4, 2, "view"), (5, 3, "view"))  # both sessions go on
    assert go() == []
    add((20, 4, "view"))
    assert go() == [(1, 1, 5.5, 3), (2, 2.5, 6, 2), (3, 5, 7, 1)]
    add((9, 1, "view"), (21, 4, "view"), (40, 5, "view"))  # the first is too late
    assert go() == [(1, 1, 5.5, 3), (2, 2.5, 6, 2), (3, 5, 7, 1), (4, 20, 23, 2)]
