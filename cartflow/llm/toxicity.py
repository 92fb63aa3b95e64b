"""Toxicity scores from subword bags: word and character n-gram vectors, averaged, under a linear softmax.

The vectors and the softmax are trained together in numpy. A misspelled word shares most n-grams with the words it
stands for. Since the layers are linear, a word adds the same logit share in every text: scoring looks words up.

Defined cases: a null text counts as empty; a text without words has an empty bag and scores by the bias alone; texts of
any length are scored whole; every row gives a row, repeated or not; a null id stays null, is never learned from and
has a null `held_out`; null labels are skipped; without labels of both kinds the score is the smoothed share of label 1;
an empty table gives no rows; columns other than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import Memo, per_batch, remainder, text_of
from cartflow.llm.quality_rules import labelled

SAMPLE_ROWS = 6_000  # about so many labelled documents are learned from, with their whole texts
FOLDS = 5
THRESHOLD = 0.5

BUCKETS = 1 << 17
GRAMS = range(3, 7)
WORDS = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of the word itself and of its character n-grams, with marks at both ends."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(x.encode("utf-8")) & (BUCKETS - 1) for x in (word + "\n", *grams)]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass
class BagModel:
    logits: np.ndarray  # of label 1 against label 0, per bucket
    bias: float

    def scorer(self):
        """Text to score. A word's entry holds its summed logits (real part) and its bag size (imaginary part)."""
        logits = self.logits

        def entry(word: str) -> complex:
            at = subwords(word)
            return complex(float(logits[at].sum()), len(at))

        memo = Memo(entry, 300_000)

        def score(text: str) -> float:
            total = sum(map(memo.__getitem__, words_of(text)), 0j)
            return float(1 / (1 + np.exp(-(self.bias + total.real / max(1.0, total.imag)))))

        return score


Bag = tuple[np.ndarray, np.ndarray]


def bags(texts: list[str], memo: Memo | None = None) -> list[Bag]:
    """Per text its distinct buckets, no more than BUCKETS, and their shares of the bag."""
    memo, out = Memo(subwords) if memo is None else memo, []
    for text in texts:
        counts: Counter[int] = Counter()
        for word, times in Counter(words_of(text)).items():
            for at in memo[word]:
                counts[at] += times
        share = np.array(list(counts.values()), np.float32)
        out.append((np.array(list(counts), np.int32), share / max(1.0, float(share.sum()))))
    return out


def fit_bags(data: list[Bag], labels: np.ndarray, size: int = 8, epochs: int = 12, rate: float = 0.4, seed: int = 11) -> BagModel:
    """Adagrad on the cross-entropy of a two-class softmax over averaged vectors."""
    n = len(labels)
    prior = (labels.sum() + 1.0) / (n + 2.0)
    base = float(np.log(prior / (1 - prior)))
    if not n or labels.min() == labels.max():
        return BagModel(np.zeros(BUCKETS), base)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    weights = random.normal(0, 1, (size, 2)).astype(np.float32)
    bias = np.array([-base / 2, base / 2], np.float32)
    squares = [np.full_like(x, 1e-8) for x in (vectors, weights, bias)]
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]

    def move(which: int, value: np.ndarray, slope: np.ndarray, at=slice(None)) -> None:
        squares[which][at] += slope**2
        value[at] -= rate * slope / np.sqrt(squares[which][at])

    for _ in range(epochs):
        order = random.permutation(n)
        for batch in np.split(order, range(32, n, 32)):
            at = np.concatenate([data[i][0] for i in batch])
            share = np.concatenate([data[i][1] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(data[i][0]) for i in batch])
            hidden = np.column_stack([np.bincount(row, share * vectors[at, k], len(batch)) for k in range(size)]).astype(np.float32)
            score = hidden @ weights + bias
            score = np.exp(score - score.max(1, keepdims=True))
            error = (score / score.sum(1, keepdims=True) - target[batch]) / len(batch)
            back = error @ weights.T
            move(1, weights, hidden.T @ error)
            move(2, bias, error.sum(0))
            used, local = np.unique(at, return_inverse=True)
            slope = np.column_stack([np.bincount(local, share * back[row, k], used.size) for k in range(size)]).astype(np.float32)
            move(0, vectors, slope, used)
    turned = vectors.astype(float) @ (weights[:, 1] - weights[:, 0]).astype(float)
    return BagModel(turned, float(bias[1] - bias[0]))


def sampled_bags(sample: DataFrame) -> DataFrame:
    """doc_id, label and the bag of each whole text, made inside the tasks: its size has a bound, that of a text has none."""

    def make():
        memo = Memo(subwords)

        def step(rows: dict) -> dict:
            found = bags(rows["text"], memo)
            packed = {"at": [at.tobytes() for at, _ in found], "share": [share.tobytes() for _, share in found]}
            return {"doc_id": rows["doc_id"], "label": rows["label"]} | packed

        return step

    kind = sample.schema["doc_id"].dataType.simpleString()
    return per_batch(sample.select("doc_id", "label", "text"), make, f"doc_id {kind}, label double, at binary, share binary")


def fit_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxic", rows: int = SAMPLE_ROWS) -> BagModel:
    """Learn from a bounded sample of about `rows` documents; their bags come to the driver."""
    got = sampled_bags(labelled(docs, labels, name, FOLDS, rows)).toPandas().sort_values("doc_id")
    data = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(got["at"], got["share"], strict=True)]
    return fit_bags(data, got["label"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: BagModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, without a shuffle."""

    def make():
        score = model.scorer()
        return lambda rows: {"doc_id": rows["doc_id"], "score": [score(text) for text in rows["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = per_batch(docs.select("doc_id", text_of(docs).alias("text")), make, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
