"""Exact top-k by inner product with MaxScore over posting lists.

Vectors are quantised to integers; a dimension is a term, its posting list the vectors that are not zero there, with
their values. Query vectors go against all rows in blocks: candidates are dealt into shards, queries into tiles, and a
task holds one shard's postings and one tile, whose queries it takes in blocks. For a query, each term bounds what it can
add to a score in this shard. Terms are ordered by bound; those whose bounds sum to less than the current k-th score are
non-essential: a candidate met in none of the others cannot enter. Essential postings are traversed for a whole block,
long ones in one product; the other terms are probed from the largest bound downwards, only for candidates that can still
reach the k-th score. The shards' top lists are merged per query by a grouping that keeps k entries.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; so do components of
other lengths than the query's, which count as zero where they are missing; rows that repeat an id are candidates each
(a query does not meet rows of its own id), and equal scores go to the smaller id; rows without an id take no part; an
empty table gives no rows; columns other than `vec_id` and `embedding` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.common import materialize, ship_package

SCALE = 256
TOP = 5
EVERY = 50
SHARD_ROWS = 16_384
BLOCK_QUERIES = 512
BLOCKS = 32  # of queries that a shard meets in one task, so that a task has as many queries as rows at most
CHUNK = 4_096  # candidates between two looks at the k-th score
LOWEST = -(1 << 62)  # below all scores
# Part of the k-th score that the bounds of the non-essential terms may reach together. With all of it half of the rows stay
# candidates when lists are long, and a probe takes much longer than a term of the product.
PROBED = 0.125


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(SCALE * x) of the components of usable vectors."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), wide.alias("x"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.exists("x", odd))
    return usable.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"))


class Postings:
    """One shard: ids ascending, per dimension the rows that are not zero there and their values.

    Lists that hold most rows are kept as columns of a matrix, the others as rows and values.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(values[order].T)
        self.rows = [np.flatnonzero(c) for c in self.columns]
        self.long = np.array([2 * len(r) > len(ids) for r in self.rows], bool)
        self.starts = [np.searchsorted(r, np.arange(0, len(ids) + CHUNK, CHUNK)) for r in self.rows]
        self.high = self.columns.max(1, initial=0)
        self.low = self.columns.min(1, initial=0)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first."""
        _, ids, scores = self.top_each(query[None], np.array([own]), k)
        return list(zip(scores.tolist(), ids.tolist(), strict=True))

    def top_each(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of a query in the block, id and score of the k best of each query, best first."""
        size = min(queries.shape[1], len(self.columns))
        queries, every = queries[:, :size], np.arange(len(queries))
        kind = self.exact(queries)
        # What a term can add at most; a row outside its list adds nothing.
        most = np.maximum(0, np.maximum(queries * self.high[:size], queries * self.low[:size]))
        order = np.argsort(most, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        below = np.concatenate((np.zeros((len(queries), 1), np.int64), np.cumsum(np.take_along_axis(most, order, 1), 1)), 1)
        own_from, own_to = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        best = (np.zeros(0, np.int64),) * 3
        for start in range(0, len(self.ids), CHUNK):
            stop = min(start + CHUNK, len(self.ids))
            last = np.searchsorted(best[0], every, "right") - 1
            full = np.bincount(best[0], minlength=len(queries)) == k
            limit = np.full(len(queries), LOWEST)
            limit[full] = best[2][last[full]]
            # Ids ascend, so a later row with the k-th score does not enter: it takes more than that.
            split = (below[:, 1:] <= np.where(limit > 0, limit * PROBED, limit)[:, None]).sum(1)
            scores = self.traversed(np.where(place >= split[:, None], queries, 0), start, stop, kind)
            for i in np.flatnonzero((own_from < stop) & (own_to > start)):
                scores[i, max(own_from[i] - start, 0) : own_to[i] - start] = LOWEST
            bar = limit - np.where(full, below[every, split], 0)
            if not full.all() and stop - start > k:
                # All terms are essential here: what is not among the k best of the chunk is not among those of the shard.
                reached = np.partition(scores, -k, axis=1)[:, -k].astype(np.int64)
                bar = np.where(full, bar, np.maximum(reached - 1, LOWEST))
            asked, row = np.divmod(np.flatnonzero(scores > bar.astype(kind)[:, None]), stop - start)
            score = scores[asked, row].astype(np.int64)
            row += start
            for probed in range(int(split.max())):
                left = np.maximum(split[asked] - probed, 0)
                alive = score + below[asked, left] > limit[asked]
                asked, row, score, left = asked[alive], row[alive], score[alive], left[alive]
                more = np.flatnonzero(left)
                term = order[asked[more], left[more] - 1]
                score[more] += queries[asked[more], term] * self.columns[term, row[more]]
            alive = score > limit[asked]
            best = k_best(*(np.concatenate((old, new[alive])) for old, new in zip(best, (asked, row, score), strict=True)), k)
        return best[0], self.ids[best[1]], best[2]

    def exact(self, queries: np.ndarray) -> type:
        """The narrowest type in which all scores, and the differences of two, are exact."""
        size = queries.shape[1]
        widest = np.maximum(self.high[:size].astype(float), -self.low[:size].astype(float))
        bound = 2 * float((np.abs(queries.astype(float)) @ widest).max(initial=0))
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64

    def traversed(self, weights: np.ndarray, start: int, stop: int, kind: type) -> np.ndarray:
        """Per query of the block and row of the chunk what the terms with a weight add."""
        size = weights.shape[1]
        long = np.flatnonzero(self.long[:size])
        scores = weights[:, long].astype(kind) @ self.columns[long, start:stop].astype(kind)
        for term in np.flatnonzero(~self.long[:size] & weights.any(0)):
            a, b = self.starts[term][start // CHUNK], self.starts[term][start // CHUNK + 1]
            rows = self.rows[term][a:b]
            scores[:, rows - start] += (weights[:, term, None] * self.columns[term, rows]).astype(kind)
        return scores


def k_best(asked: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the highest scores, best first, equal ones by row."""
    ranked = np.lexsort((row, -score, asked))
    ranked = ranked[np.arange(len(ranked)) - np.searchsorted(asked[ranked], asked[ranked]) < k]
    return asked[ranked], row[ranked], score[ranked]


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the (vec_id, v) of `queries` against all rows of `vectors`."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(vectors, "vectors")
    asked = materialize(queries, "queries")
    shards, tiles = (max(1, -(-x.count() // n)) for x, n in ((rows, shard_rows), (asked, block * BLOCKS)))
    # A shard meets every tile of blocks once: shards x tiles groups. The rows are copied once per tile, the queries once per shard.
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    left = deal(rows, shards, "shard").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = deal(asked, tiles, "tile").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def both(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if candidates.num_rows and asking.num_rows:
            postings = Postings(candidates["vec_id"].to_numpy(), matrix(candidates["v"]))
            ids, queries = asking["vec_id"].to_numpy(), matrix(asking["v"])
            for start in range(0, len(ids), block):
                own = ids[start : start + block]
                place, vec_id, score = postings.top_each(queries[start : start + block], own, k)
                found.append((own[place], vec_id, score))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    # A number of partitions that is asked for stays: merged to the size of their input, which is small, they would leave cores idle.
    left, right = (x.repartition(shards * tiles, "shard", "tile") for x in (left, right))
    met = left.groupBy("shard", "tile").cogroup(right.groupBy("shard", "tile"))
    partial = met.applyInArrow(both, "query_id bigint, vec_id bigint, score bigint")
    return merged(partial, k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows; shorter ones are filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy()
    out = np.zeros((len(lengths), lengths.max()), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = pc.list_flatten(column).to_numpy()
    return out


def merged(partial: DataFrame, k: int) -> DataFrame:
    """The best k of all shards; a query has at most k rows from each of them."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
