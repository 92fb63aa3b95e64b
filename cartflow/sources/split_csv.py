"""CSV files with line breaks inside quotes, read by many tasks each.

Whether a line break ends a record depends on the number of quotes before it, which a task that starts in the middle of a
file does not know. A first pass counts the quotes of every split; their sums tell of each split whether it starts inside
quotes. With that, a second pass puts lines together to records where they are, and only what a split has of a record
that began in an earlier one is moved, to be joined with its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = "file string, split bigint, part int, number bigint, text string"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where it starts) and text of all lines; the lines of a split are in order within a task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text"))


def quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def open_splits(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether a split starts inside quotes. One entry per split, of which the driver holds a list anyway.

    A file whose quotes do not close is an error.
    """
    counted = lines.groupBy("file", "split").agg(F.sum(quotes(F.col("text"))).alias("n"))
    running = Window.partitionBy("file").orderBy("split")
    rows = counted.select("file", "split", "n", F.sum("n").over(running).alias("upto")).orderBy("file", "split").collect()
    last = {r["file"]: r["upto"] for r in rows}
    unclosed = sorted(file for file, n in last.items() if n % 2)
    if unclosed:
        raise ValueError(f"quotes do not close in {unclosed[0]}")
    return {(r["file"], r["split"]): bool((r["upto"] - r["n"]) % 2) for r in rows}


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, split, number (from 0 in each split) and text of every record; the one at (0, 0) is a file's header."""
    lines = lines_of(spark, path)
    starts = open_splits(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # part 0: a record, or the beginning of one that goes on in the next splits; part 1: the rest of an earlier one.
        now, inside, held, number, part = None, False, [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, number, part
            if held:
                out.append((*now, part, number, "\n".join(held)))
                number += part == 0
            held, part = [], 0

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for file, split, text in zip(*columns, strict=True):
                if (file, split) != now:
                    close()
                    now, inside, number = (file, split), starts[file, split], 0
                    part = int(inside)
                held.append(text)
                inside ^= text.count('"') % 2 == 1
                if not inside:
                    close()
            yield table(out)
            out = []
        close()
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "split", "part", "number", "text"])

    found = lines.mapInArrow(run, RECORDS)
    # Where a split's last record goes on, and which splits that takes: few entries, known before the records are read.
    ordered = sorted(starts)
    follows: dict[tuple[str, int], tuple[str, int]] = {}
    for before, at in zip(ordered, ordered[1:], strict=False):
        if starts[at] and before[0] == at[0]:
            follows[at] = before
    return joined(found, follows) if follows else found.select("file", "split", "number", "text")


def joined(found: DataFrame, follows: dict[tuple[str, int], tuple[str, int]]) -> DataFrame:
    """The records, those over several splits put together from their pieces."""
    spark = found.sparkSession
    links = spark.createDataFrame([(f, s, b) for (f, s), (_, b) in follows.items()], "file string, split bigint, before bigint")
    # A piece of a split that holds nothing else hands its successor on: `first` is where the record begins.
    heads = found.where("part = 0").groupBy("file", "split").agg(F.max("number").alias("last"))
    chain = links.join(heads, (links["file"] == heads["file"]) & (links["before"] == heads["split"]), "left").select(
        links["file"], links["split"], F.when(F.col("last").isNotNull(), F.col("before")).alias("first")
    )
    running = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.select("file", "split", F.last("first", ignorenulls=True).over(running).alias("first"))
    rest = found.where("part = 1").join(chain, ["file", "split"]).select("file", F.col("first").alias("split"), F.col("split").alias("at"), "text")
    ends = heads.join(chain.select("file", F.col("first").alias("split")).distinct(), ["file", "split"])
    begun = found.where("part = 0").join(ends, ["file", "split"], "left")
    cut = F.col("number") == F.col("last")
    whole = begun.where(F.col("last").isNull() | ~cut).select("file", "split", "number", "text")
    begin = begun.where(cut).select("file", "split", F.col("split").alias("at"), "text", "number")
    pieces = begin.unionByName(rest, allowMissingColumns=True)
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n")
    # As many pieces as splits that one record covers.
    glued = pieces.groupBy("file", "split").agg(F.max("number").alias("number"), texts.alias("text"))
    return whole.unionByName(glued.select("file", "split", "number", "text"))


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, file: str | None = None) -> DataFrame:
    """The rows of `files.read_csv_strict` with `multi_line`; a file is read by as many tasks as it has splits.

    A differing header or a malformed record fails the job. Empty lines between records are passed over. `file` names a
    further column for the path of the file.
    """
    found = records(spark, path).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    header = (F.col("split") == 0) & (F.col("number") == 0)
    options = {"escape": '"', "mode": "FAILFAST"}
    plain = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(schema))), options)
    names = F.array(*[plain[f"c{i}"] for i in range(len(schema))])
    same = F.when(names == F.array(*[F.lit(n) for n in schema.fieldNames()]), F.lit(False))
    is_row = F.when(header, same.otherwise(F.raise_error(F.lit("the header differs from the schema")).cast("boolean"))).otherwise(F.col("text") != "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = found.where(is_row).select(F.from_csv("text", ddl, options).alias("row"), "file")
    return rows.select("row.*", *([F.col("file").alias(file)] if file else []))
