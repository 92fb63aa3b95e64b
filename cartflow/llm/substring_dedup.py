"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences (behind a word that ends in `.`, `!` or `?`, and at line ends); a long stretch without
them is also cut at words whose hash is the lowest in their neighbourhood, so that a passage is cut alike wherever it
stands. Every run of consecutive sentences is hashed that has at least RUN of them and WORDS words, and no more than it
needs. The hashes are joined over all documents, and each sentence that lies in an occurrence other than the first one
is removed. First is the smallest id, then the earliest place. A repeated passage of over 50 words holds such a run even
if it starts and ends inside sentences of its host; of it stay at most the sentences that it shares with the host.

Defined cases: a null text stays null; a text without words stays as it is; texts of any length are cut whole; a
repeat inside one text counts too; a copy of a document loses all sentences that lie in runs; rows with the same id
count as one document, so that what repeats among them alone stays; a row without an id stands for itself, behind all
others; an empty table gives no rows; all columns are kept, and only `text` changes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import Memo, materialize, per_batch, ship_package, text_of

RUN = 3
WORDS = 15
NEAR = 3  # a word that starts a cut has the lowest hash among so many words on both sides

WORD = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def low_points(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words whose hash is lower than the NEAR before and not higher than the NEAR behind, all in one sentence."""
    n, out = len(hashes), np.zeros(len(hashes), bool)
    if n <= 2 * NEAR:
        return out
    low, centre = np.ones(n - 2 * NEAR, bool), hashes[NEAR : n - NEAR]
    for k in range(1, NEAR + 1):
        low &= (centre < hashes[NEAR - k : n - NEAR - k]) & (centre <= hashes[NEAR + k : n - NEAR + k])
    sentence = np.cumsum(starts)
    out[NEAR : n - NEAR] = low & (sentence[: n - 2 * NEAR] == sentence[2 * NEAR :])
    return out


class Cutter:
    def __init__(self):
        self.memo = Memo(lambda word: xxhash.xxh64_intdigest(word))

    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def sentences(self, text: str, hashes: np.ndarray) -> np.ndarray:
        """The index of the first word of each sentence, and the number of words."""
        lines = text.split("\n")
        starts = np.zeros(len(hashes) + 1, bool)
        at = 0
        for line in lines:
            starts[at] = True
            words = line.split()
            closing = [i for i, w in enumerate(words, at + 1) if w[-1] in ".!?"]
            starts[closing] = True
            at += len(words)
        starts[-1] = True
        starts[:-1] |= low_points(hashes, starts[:-1])
        return np.flatnonzero(starts)


def runs_of(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run its first sentence, the sentence behind it, and its hash."""
    count = len(first) - 1
    last = np.maximum(np.arange(count) + RUN, np.searchsorted(first, first[:-1] + WORDS))
    start = np.flatnonzero(last <= count)
    last = last[start]
    # The hash is a polynomial over the words modulo 2^64: a difference of two prefixes, shifted to the first power.
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(hashes) + 1, BASE, np.uint64))
        back = np.cumprod(np.full(len(hashes) + 1, INVERSE, np.uint64))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])))
        low, high = first[start], first[last]
        value = (prefix[high] - prefix[low]) * back[low] + (high - low).astype(np.uint64)
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return start, last, (value ^ (value >> np.uint64(29))).view(np.int64)


def own_key(doc_id: Column, text: Column) -> Column:
    """The id as a number; rows without one get a hash of their text, above the ids."""
    spare = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    return F.coalesce(doc_id.cast("bigint"), spare)


def spans(texts: DataFrame) -> DataFrame:
    """key, the distinct hashes of its runs, and whether one of them occurs twice. No shuffle."""

    def make():
        cutter = Cutter()

        def step(rows: dict) -> dict:
            found, twice = [], []
            for text in rows["text"]:
                hashes = cutter.hashes(text)
                _, _, runs = runs_of(cutter.sentences(text, hashes), hashes)
                distinct = np.unique(runs)
                found.append(distinct.tolist())
                twice.append(len(distinct) < len(runs))
            return {"key": rows["key"], "runs": found, "twice": twice}

        return step

    return per_batch(texts, make, "key bigint, runs array<bigint>, twice boolean")


def repeated(texts: DataFrame) -> DataFrame:
    """key, drop: the runs of each document that occur in an earlier one; empty where only the text repeats itself.

    First occurrences are a grouping with map-side combine on two numbers. Only hashes of more than one document are
    joined back, where a common one can be split. The lists are no longer than the documents.
    """
    stored = materialize(spans(texts), "spans")
    rows = stored.select("key", F.explode("runs").alias("run"))
    ends = rows.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    later = rows.join(ends.select("run", "first"), "run").where("key > first").select("key", "run")
    inside = stored.where("twice").select("key", F.lit(None).cast("bigint").alias("run"))
    return later.union(inside).groupBy("key").agg(F.collect_list("run").alias("drop"))


def without(cutter: Cutter, text: str, drop: set[int]) -> str:
    """The text without the sentences of dropped runs and of runs that it had before."""
    hashes = cutter.hashes(text)
    first = cutter.sentences(text, hashes)
    gone, seen = np.zeros(len(first), int), set()
    for start, last, run in zip(*(x.tolist() for x in runs_of(first, hashes)), strict=True):
        if run in drop or run in seen:
            gone[start] += 1
            gone[last] -= 1
        seen.add(run)
    covered = np.cumsum(gone)[:-1] > 0
    if not covered.any():
        return text
    places = np.array([m.start() for m in WORD.finditer(text)] + [len(text)])[first]
    kept = [text[a:b] for a, b, c in zip(places[:-1], places[1:], covered, strict=True) if not c]
    return (text[: places[0]] + "".join(kept)).rstrip()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All documents with all their columns; repeated passages are taken out of `text`."""
    ship_package(docs.sparkSession)
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), own_key(docs["doc_id"], text_of(docs)).alias("__key")
    )
    texts = docs.select(own_key(docs["doc_id"], text_of(docs)).alias("key"), text_of(docs).alias("text"))
    drops = repeated(texts).select(F.col("key").alias("__key"), F.col("drop").alias("__drop"))

    @F.pandas_udf("string")
    def shortened(text: pd.Series, drop: pd.Series) -> pd.Series:
        cutter = Cutter()
        return pd.Series([None if t is None else without(cutter, t, set(map(int, d))) for t, d in zip(text, drop, strict=True)], dtype=object)

    joined = keyed.join(drops, "__key", "left")
    affected = F.col("__drop").isNotNull()
    # Only texts with something to remove travel to Python.
    changed = joined.withColumn("__new", shortened(F.when(affected, F.col("__row.text")), "__drop"))
    text = F.when(affected, F.col("__new")).otherwise(F.col("__row.text"))
    return changed.select(*[(text if n == "text" else F.col(f"__row.`{n}`")).alias(n) for n in names])
