import os

import pytest

from cartflow import session


def test_shuffles_grow_with_the_input_only(spark, tmp_path, monkeypatch):
    path, name = str(tmp_path / "t"), "spark.sql.shuffle.partitions"
    spark.range(1000).write.parquet(path)
    before = spark.conf.get(name)
    with session.sized_shuffles(spark, path):
        assert spark.conf.get(name) == before
    monkeypatch.setattr(session, "PARTITION_BYTES", session.input_bytes(spark, path) // 40)
    with session.sized_shuffles(spark, path):
        assert spark.conf.get(name) in ("40", "41")
    assert spark.conf.get(name) == before


def test_stored_tables_can_be_deleted(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    hidden = session.scratch_root(spark).removeprefix("file:")
    assert os.path.isdir(hidden) and os.path.isdir(path.removeprefix("file:"))


def test_intermediates_are_files_without_lineage(spark):
    stored = session.materialize(spark.range(10).selectExpr("id", "id % 3 AS k"), "kept")
    assert stored.count() == 10
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()
    assert os.path.isdir(session.scratch_dir(spark))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


class Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_only_a_local_session_makes_its_own_folder():
    local = Unset("local[2]")
    assert os.path.isdir(session.scratch_dir(local))
    assert session.scratch_dir(local) == local.folder
    with pytest.raises(ValueError):
        session.scratch_dir(Unset("yarn"))
