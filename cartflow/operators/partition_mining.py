"""Frequent itemsets in two passes over partitions of the baskets.

An itemset that is frequent overall is frequent in at least one partition, at the same share of its baskets. So the first
pass mines each partition by itself, and what it finds anywhere are the candidates; the second pass counts every
candidate in every partition, and the sums decide. Both passes walk the items of a partition depth first, with flat
arrays of the baskets that hold the items so far: memory is a small multiple of a partition, whatever the support.

Equal baskets are one row with their number, so that over few items the work grows with the different baskets only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.session import materialize

# Different baskets of a partition. A low support takes larger ones, so that its count in a partition is not below LEAST_COUNT:
# with fewer, chance would make too many candidates.
PART_BASKETS = 50_000
LEAST_COUNT = 25
# Candidates that meet a partition in one task.
CHUNK = 200_000

Extend = Callable[[tuple, np.ndarray, np.ndarray], Iterator[tuple[int, int]]]


def parts_for(baskets: int, least: int) -> int:
    """Partitions for so many different baskets, where `least` baskets make an itemset frequent."""
    return max(1, min(-(-baskets // PART_BASKETS), least // LEAST_COUNT))


def walk(prefix: tuple, ends: np.ndarray, items: np.ndarray, times: np.ndarray, extend: Extend) -> Iterator[tuple[tuple, int]]:
    """Itemsets that begin with `prefix`, with their counts, in the baskets that hold it.

    `items` has what those baskets hold behind the prefix, basket after basket and ascending in each; `ends` tells of
    every position where its basket ends, `times` how often the basket occurs. `extend` chooses the items to add, from
    all of them with their counts.
    """
    order = np.argsort(items, kind="stable")
    values, starts, sizes = np.unique(items[order], return_index=True, return_counts=True)
    counts = np.add.reduceat(times[order], starts) if starts.size else sizes
    for which, count in extend(prefix, values, counts):
        at = order[starts[which] : starts[which] + sizes[which]]
        name = (*prefix, int(values[which]))
        yield name, count
        rest = ends[at] - at - 1
        total = np.cumsum(rest)
        if total.size and total[-1]:
            # The positions behind each of `at`, up to the end of its basket.
            behind = np.arange(total[-1]) + np.repeat(at + 1 - total + rest, rest)
            yield from walk(name, np.repeat(total, rest), items[behind], np.repeat(times[at], rest), extend)


def flat(rows: pa.Table, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all baskets the end of the basket at every position, the items, ascending in each, and how often it occurs.

    `chosen` picks the single items that stay, from all of them with their counts.
    """
    lists = rows["items"].combine_chunks()
    lengths, items = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    number = rows["n"].to_numpy()
    values, which = np.unique(items, return_inverse=True)
    stays = chosen(values, np.bincount(which, number[row], len(values)))[which]
    del which
    items, row = items[stays], row[stays]
    items = items[np.lexsort((items, row))]
    lengths = np.bincount(row, minlength=len(lengths))
    return np.repeat(np.cumsum(lengths), lengths), items, number[row]


def frequent_in(rows: pa.Table, least: int) -> Iterator[tuple[tuple, int]]:
    """The itemsets in at least `least` of these baskets (`items`, `n` times each)."""

    def extend(prefix: tuple, values: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        for which in np.flatnonzero(counts >= least).tolist():
            yield which, int(counts[which])

    return walk((), *flat(rows, lambda values, counts: counts >= least), extend)


def counts_of(rows: pa.Table, wanted: list[list[int]]) -> Iterator[tuple[tuple, int]]:
    """The counts of the wanted itemsets in these baskets; those without a basket are left out.

    `wanted` is a trie: with an itemset it has all its beginnings.
    """
    children: dict[tuple, list[int]] = {}
    for itemset in wanted:
        children.setdefault(tuple(itemset[:-1]), []).append(itemset[-1])
    single = np.unique([item for itemset in wanted for item in itemset])

    def extend(prefix: tuple, values: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        found = np.flatnonzero(np.isin(values, children.get(prefix, [])))
        yield from zip(found.tolist(), counts[found].tolist(), strict=True)

    return walk((), *flat(rows, lambda values, counts: np.isin(values, single)), extend)


def as_table(found: Iterator[tuple[tuple, int]], kind: pa.DataType) -> pa.Table:
    itemsets, counts = [], []
    for itemset, count in found:
        itemsets.append(itemset)
        counts.append(count)
    # The schema allows nulls, also where the baskets can't hold one.
    return pa.table({"items": pa.array(itemsets, pa.list_(kind.value_type)), "freq": pa.array(counts, pa.int64())})


def partition_itemsets(training: DataFrame, least: int, baskets: int, parts: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Itemsets in at least `least` of the `baskets` training baskets: `(items, freq)`, items ascending.

    A row of `training` is one basket, or `n` equal ones where it has that column; such a table should be stored, with its
    baskets gathered, since it is mined as it is.
    """
    if not 0 < least <= baskets:
        return training.select("items", F.lit(0).cast("long").alias("freq")).where("false")
    different = training
    if "n" not in training.columns:
        equal = training.groupBy(F.sort_array("items").alias("items")).agg(F.count(F.lit(1)).alias("n"))
        different = materialize(equal, "different_baskets")
    rows = different.count()
    # The share of the different baskets: a part without a very frequent basket is no smaller than that.
    parts = parts or parts_for(rows, least * rows // baskets)
    schema = f"items {training.schema['items'].dataType.simpleString()}, freq bigint"
    dealt = different.select("items", "n", F.pmod(F.xxhash64("items"), F.lit(parts)).cast("int").alias("part"))

    def mine(rows: pa.Table) -> pa.Table:
        # The same share of this partition, rounded up.
        here = -(-least * int(rows["n"].to_numpy().sum()) // baskets)
        return as_table(frequent_in(rows, here), rows.schema.field("items").type)

    local = dealt.groupBy("part").applyInArrow(mine, schema)
    if parts == 1:
        return local
    wanted = materialize(local.select("items").distinct(), "candidates")
    chunks = -(-wanted.count() // chunk)
    # Itemsets of one first item stay together, so a chunk is a trie of its own.
    wanted = wanted.withColumn("chunk", F.pmod(F.hash(F.get("items", F.lit(0))), F.lit(max(1, chunks))))
    every = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))
    left = every(dealt, chunks, "chunk").groupBy("part", "chunk")
    right = every(wanted, parts, "part").groupBy("part", "chunk")

    def count(held: pa.Table, asked: pa.Table) -> pa.Table:
        found = counts_of(held, asked["items"].to_pylist()) if held.num_rows and asked.num_rows else iter(())
        return as_table(found, asked.schema.field("items").type)

    counted = left.cogroup(right).applyInArrow(count, schema)
    return counted.groupBy("items").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)
