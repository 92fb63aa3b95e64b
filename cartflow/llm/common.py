"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.session import discard, materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(df["text"], F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def in_sample(key: Column, rows: int, limit: int) -> Column:
    """True for about `limit` of `rows` keys, chosen by a hash of the key alone; for all when they are fewer."""
    slots = 1_000_000
    share = slots if rows <= limit else int(slots * limit / rows)
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(slots)) < share


class Memo(dict):
    """Results of a pure function of a text unit, in two generations of `limit` entries each.

    Units recur so often that nearly every lookup is answered here. Only the speed depends on the limit. Units above
    `longest` characters, such as texts without spaces, are not remembered, so that memory has a bound in bytes.
    """

    longest = 64

    def __init__(self, compute: Callable, limit: int = 500_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()

    def __missing__(self, unit):
        self.trim()
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(unit) <= self.longest:
            self[unit] = value
        return value

    def forget(self, units: Iterable) -> None:
        """Drop those of the units, put in by the caller, that are too long to stay."""
        for unit in units:
            if len(unit) > self.longest:
                del self[unit]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(root.rglob("*.py")):
            target.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def per_batch(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Map record batches: `make` runs once per task, its result turns columns (lists) into columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrow = make(), to_arrow_schema(target)
        for batch in batches:
            for part in pieces(batch):
                out = step(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, target: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about `target` bytes, so that a few long texts do not multiply in memory."""
    rows = max(1, int(batch.num_rows * target / max(target, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


__all__ = ["Memo", "discard", "in_sample", "materialize", "per_batch", "pieces", "remainder", "ship_package", "table", "text_of"]
