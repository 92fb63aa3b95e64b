"""Windowed totals and sessions of an event stream.

State is kept by Spark's own operators: per window and group, or per open session of a key. The watermark bounds it; rows
that come later than the delay are left out and can be counted. A run takes whatever has arrived and stops, so that it
fits a schedule; its checkpoint folder carries state and progress to the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "1 day"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The events of a folder of Parquet files as a stream; times are UTC."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_totals(events: DataFrame, size: str = "1 day", delay: str = DELAY) -> DataFrame:
    """starts, event_type, n, total per window. Partial sums are made before the shuffle."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    totals = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return totals.select(F.col("window.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """user_id, starts, ends, n per session: events of a user of which none comes `gap` or more after the one before.

    `ends` is the last event and the gap. A session leaves the state when the watermark has passed its end. Rows without a
    user have none.
    """
    known = events.where(F.col("user_id").isNotNull()).withWatermark("ts", delay)
    found = known.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def write_batch(sink: str):
    """A batch writer: each batch has a folder of its own, which a replay of the batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return write


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "update") -> int:
    """Process what has arrived since the last run with this checkpoint. Returns the number of the last batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(write_batch(sink)).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else int(progress["batchId"])


def written(spark: SparkSession, sink: str) -> DataFrame:
    """All batches: the result of a stream in append mode."""
    return spark.read.option("basePath", sink).parquet(sink)


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The last state of every key: the result of a stream in update mode. A grouping with map-side combine."""
    rows = written(spark, sink)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def late_rows(events: DataFrame, totals: DataFrame) -> DataFrame:
    """arrived, counted, late: how many of all events are in the totals, and how many came too late for them."""
    arrived = events.where(F.col("ts").isNotNull()).agg(F.count(F.lit(1)).alias("arrived"))
    counted = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    both = arrived.withColumn("counted", F.lit(None).cast("long")).unionByName(counted.withColumn("arrived", F.lit(None).cast("long")))
    sums = both.agg(F.max("arrived").alias("arrived"), F.max("counted").alias("counted"))
    return sums.withColumn("late", F.col("arrived") - F.col("counted"))
