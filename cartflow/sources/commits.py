"""Layers of several tables that change in one step.

The tables of a layer are written to folders of their own, `<root>/<table>/<unique>`, which no reader looks for by name.
A commit is one small file, `<root>/.commits/<number>.json`, with the folder and row count of every table; it is written
under another name and then moved to the next number, which must be free. So a layer is there as a whole or not at all,
a run that dies leaves the last commit as it was, and of two writers that started from one commit the second one fails.
Readers take the last commit once and read all their tables from it; earlier commits stay readable until they are
cleaned up.

The file system must not overwrite on such a move (`FileContext.rename` without `OVERWRITE`).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartflow.sources import files

FOLDER = ".commits"
DIGITS = 12


class CommitConflict(FileExistsError):
    """Another writer has committed since this one began; what it wrote stays without effect."""


@dataclass(frozen=True)
class Snapshot:
    """One commit of a layer: per table its folder below `root` and its rows."""

    spark: SparkSession
    root: str
    number: int
    tables: dict[str, tuple[str, int]]

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise FileNotFoundError(f"{self.root} has no table {name}")
        return self.spark.read.parquet(f"{self.root}/{self.tables[name][0]}")


def numbers(spark: SparkSession, root: str) -> list[int]:
    """All commits, ascending."""
    folder, fs = files.hadoop(spark, f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    """The last commit or the one asked for; None where nothing has been committed."""
    root = root.rstrip("/")
    known = numbers(spark, root)
    if number is None and not known:
        return None
    if number is not None and number not in known:
        raise FileNotFoundError(f"{root} has no commit {number}")
    number = known[-1] if number is None else number
    path, fs = files.hadoop(spark, f"{root}/{FOLDER}/{number:0{DIGITS}}.json")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(spark, root, number, {name: (t["folder"], t["rows"]) for name, t in json.loads(text).items()})


def _move_to_free(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    source_path, _ = files.hadoop(spark, source)
    target_path, _ = files.hadoop(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target_path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(source_path, target_path, nothing)


class Writer:
    """Collects the tables of the next commit of a layer, which it bases on the last one."""

    def __init__(self, spark: SparkSession, root: str, replace: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        known = numbers(spark, self.root)
        if known and not replace:
            raise FileExistsError(f"{self.root} has commit {known[-1]}")
        self.base = known[-1] if known else 0
        self.tables: dict[str, tuple[str, int]] = {}

    def store(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and verify a table; it is seen by others with the commit only. Returns what was stored."""
        folder = f"{name}/{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}"
        self.tables[name] = (folder, files.write_verified(df, path, rows))
        return self.spark.read.parquet(path)

    def commit(self) -> Snapshot:
        """Make all stored tables the content of the layer."""
        for name, (folder, rows) in self.tables.items():
            if self.spark.read.parquet(f"{self.root}/{folder}").count() != rows:
                raise ValueError(f"{self.root}/{folder}: the stored row count of {name} differs")
        text = json.dumps({name: {"folder": f, "rows": n} for name, (f, n) in sorted(self.tables.items())}, indent=1)
        number = self.base + 1
        target = f"{self.root}/{FOLDER}/{number:0{DIGITS}}.json"
        waiting = f"{self.root}/{FOLDER}/.{uuid.uuid4().hex}"
        path, fs = files.hadoop(self.spark, waiting)
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            _move_to_free(self.spark, waiting, target)
        except Exception as error:
            fs.delete(path, False)
            if number in numbers(self.spark, self.root):
                raise CommitConflict(f"{self.root} has commit {number} of another writer") from error
            raise
        return Snapshot(self.spark, self.root, number, dict(self.tables))


def clean(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last `keep` commits and the table folders that none of these names. Returns their number.

    Not to be run beside a writer: what it has stored so far is in no commit.
    """
    root = root.rstrip("/")
    known = numbers(spark, root)
    kept = {folder for n in known[-keep:] for folder, _ in snapshot(spark, root, n).tables.values()}
    for number in known[:-keep]:
        path, fs = files.hadoop(spark, f"{root}/{FOLDER}/{number:0{DIGITS}}.json")
        fs.delete(path, False)
    gone = 0
    folder, fs = files.hadoop(spark, root)
    for table in fs.listStatus(folder) if fs.exists(folder) else []:
        name = table.getPath().getName()
        if name.startswith(".") or not table.isDirectory():
            continue
        for version in fs.listStatus(table.getPath()):
            if f"{name}/{version.getPath().getName()}" not in kept:
                fs.delete(version.getPath(), True)
                gone += 1
    return gone
