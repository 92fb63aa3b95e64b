"""Records over many splits of one file against the strict reader, which takes a file per task."""

import random

import pytest
from pyspark.sql import types as T

from cartflow.sources import files
from cartflow.sources.split_csv import open_splits, lines_of, read_csv_split, records

SCHEMA = T.StructType().add("id", "integer").add("name", "string").add("note", "string")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files; some values go over many lines, and more than one split."""
    rng, root = random.Random(1), tmp_path_factory.mktemp("csv")
    pieces = ["plain", 'say "so"', "a,b", "line\nbreak", "\n\n", "ü日本", "", "x" * 40, '"', "tail\r\nhere"]
    for number in range(2):
        rows = ["id,name,note\n"]
        for i in range(400):
            name = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) or "none"
            note = "\n".join(["word word"] * 300) if i % 97 == 5 else rng.choice(["", "n", quoted("two\nlines")])
            note = quoted(note) if i % 97 == 5 else note
            rows.append(f"{i},{quoted(name)},{note}" + "\n" * (1 + (i % 50 == 7)))
        (root / f"part{number}.csv").write_text("".join(rows), encoding="utf-8", newline="")
    return str(root)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equal_to_the_strict_reader(spark, folder, small_splits):
    found = read_csv_split(spark, folder, SCHEMA)
    splits = open_splits(lines_of(spark, folder))
    assert len(splits) > 60 and any(splits.values())
    # Values of 2,700 characters leave splits of 700 without a line break that ends a record.
    spans = {(r.file, r.split) for r in records(spark, folder).collect()}
    assert len(spans) < len(splits)
    expected = rows_of(files.read_csv_strict(spark, folder, SCHEMA))
    assert rows_of(found) == expected and len(expected) == 800


def test_one_split_and_an_exported_table(spark, folder, tmp_path):
    assert rows_of(read_csv_split(spark, folder, SCHEMA)) == rows_of(files.read_csv_strict(spark, folder, SCHEMA))
    table = spark.createDataFrame([(1, 'a "b"\nc', "x"), (2, None, "y,z")], SCHEMA)
    files.export_csv(table, str(tmp_path / "out"))
    assert rows_of(read_csv_split(spark, str(tmp_path / "out"), SCHEMA)) == rows_of(table)


@pytest.mark.parametrize("text", ["id,name,other\n1,a,b\n", "id,name,note\nx,a,b\n", 'id,name,note\n1,"a,b\n2,c,d\n'])
def test_faulty_files_fail(spark, tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    with pytest.raises(Exception, match="CAST_INVALID|MALFORMED|CANNOT_PARSE|NumberFormat|header differs|do not close"):
        read_csv_split(spark, str(tmp_path / "f.csv"), SCHEMA).collect()
