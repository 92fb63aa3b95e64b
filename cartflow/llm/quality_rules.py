"""Quality scores by a sparse rule ensemble.

Boosted shallow trees on text statistics give conjunctive rules (every path from a root), lasso logistic regression
keeps few of them, and the kept rules become one Spark column expression: scoring is a projection without Python.

Defined cases: a null text counts as empty and is scored like one; texts of any length are measured whole; every row
gives a row, repeated or not; a null id stays null, is never learned from and has a null `held_out`; null labels are
skipped; without labels, with labels of one kind only, or where no statistic splits them, the score is the (smoothed)
share of label 1; an empty table gives no rows; columns other than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import in_sample, remainder, text_of

SAMPLE_ROWS = 20_000  # at most about so many labelled documents are measured for the fit
FOLDS = 5
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Measures of a whole text, all of them per character, word or line."""
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    chars = F.greatest(F.length(text), F.lit(1))
    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": chars / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(text, F.lit(r"\p{N}")) / chars,
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,'’]")) / chars,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] > self.cut if self.above else values[self.name] <= self.cut

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut


Rule = tuple[Condition, ...]


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score over columns named as in `statistics`."""
        terms = [
            F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(weight)).otherwise(F.lit(0.0))
            for rule, weight in self.rules
        ]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def best_split(values: np.ndarray, target: np.ndarray, least: int) -> tuple[float, float] | None:
    """The cut of one statistic that lowers the squared error most: (gain, cut)."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], target[order]
    sums, n = np.cumsum(t), np.arange(1, len(t) + 1)
    ends = np.flatnonzero(v[:-1] < v[1:])
    ends = ends[(ends + 1 >= least) & (len(t) - ends - 1 >= least)]
    if not ends.size:
        return None
    left, total = sums[ends], sums[-1]
    gain = left**2 / n[ends] + (total - left) ** 2 / (len(t) - n[ends]) - total**2 / len(t)
    best = int(np.argmax(gain))
    return float(gain[best]), float((v[ends[best]] + v[ends[best] + 1]) / 2)


def grow(values: dict[str, np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule = ()):
    """A regression tree as (path, rows) of its nodes below the root, leaves marked by True."""
    found = []
    if depth:
        splits = [(s, name) for name, v in values.items() if (s := best_split(v[rows], target[rows], least))]
        if splits:
            (gain, cut), name = max(splits, key=lambda s: (s[0][0], s[1]))
            if gain > 1e-9:
                for above in (False, True):
                    condition = Condition(name, above, cut)
                    inside = rows[condition.holds({name: values[name][rows]})]
                    found += grow(values, target, inside, depth - 1, least, (*path, condition))
                return [(path, rows, False), *found] if path else found
    return [(path, rows, True)]


def fit_rules(
    values: dict[str, np.ndarray], labels: np.ndarray, trees: int = 24, depth: int = 3, shrinkage: float = 0.3,
    penalty: float = 0.002, seed: int = 7,
) -> RuleModel:
    """Rules from boosted trees on random halves of the rows, weighted by lasso logistic regression."""
    n = len(labels)
    prior = (labels.sum() + 1.0) / (n + 2.0)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or labels.min() == labels.max():
        return RuleModel(base)
    random, margin, rules = np.random.default_rng(seed), np.full(n, base), {}
    for _ in range(trees):
        rows = np.sort(random.permutation(n)[: max(2, n // 2)])
        rest = labels - 1 / (1 + np.exp(-margin))
        for path, inside, leaf in grow(values, rest, rows, depth, least=max(2, n // 500)):
            if not path:
                continue
            holds = np.logical_and.reduce([c.holds(values) for c in path])
            rules.setdefault(path, holds)
            if leaf:
                variance = np.mean(labels * 0 + 0.25) if not inside.size else max(0.02, float(np.mean(0.25 - rest[inside] ** 2 / 4)))
                margin += holds * shrinkage * float(rest[inside].mean() if inside.size else 0.0) / variance
    paths = list(rules)
    if not paths:
        return RuleModel(base)
    return lasso(paths, np.column_stack([rules[p] for p in paths]).astype(float), labels, base, penalty)


def lasso(paths: list[Rule], holds: np.ndarray, labels: np.ndarray, base: float, penalty: float, steps: int = 600) -> RuleModel:
    """Accelerated proximal gradient; the bias is not penalised."""
    n = len(labels)
    design = np.column_stack([np.ones(n), holds])
    weights = np.zeros(design.shape[1])
    weights[0] = base
    # A power iteration bounds the curvature of the logistic loss.
    probe = np.ones(design.shape[1])
    for _ in range(30):
        probe = design.T @ (design @ probe)
        size = float(np.linalg.norm(probe))
        probe /= size
    step, ahead, momentum = 4 * n / size, weights.copy(), 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - labels) / n
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        weights, momentum = new, following
    kept = [(path, float(w)) for path, w in zip(paths, weights[1:], strict=True) if abs(w) > 1e-6]
    return RuleModel(float(weights[0]), kept)


def labelled(docs: DataFrame, labels: DataFrame, name: str, folds: int, rows: int) -> DataFrame:
    """doc_id, text and `label` (0/1) of a bounded sample of the rows that may be learned from: one per id.

    Ids are sampled first, from the narrow label table, so that about `rows` ids are sent to all executors. Where labels
    or documents repeat an id, the largest label and the first text in order count.
    """
    usable = labels.select(labels["doc_id"].alias("doc_id"), labels[name].cast("double").alias("label"))
    usable = usable.where(F.col("label").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.where(in_sample(F.col("doc_id"), usable.count(), rows))
    found = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def with_statistics(texts: DataFrame, *kept: str) -> DataFrame:
    """The columns `kept` and the statistics of `text`.

    They leave a generator, so that whatever is computed or filtered above it reads finished numbers. Were they plain
    columns, the optimizer would put their expressions into each condition of each rule of a filter on the score.
    """
    values = F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return texts.select(*kept, F.inline(F.array(values)))


def fit_quality(docs: DataFrame, labels: DataFrame, name: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Measure the sample in Spark; only its numbers reach the driver."""
    sample = labelled(docs, labels, name, FOLDS, rows)
    measured = with_statistics(sample, "label").toPandas()
    # The order of rows from the cluster varies; sorted, the fit is the same each time.
    measured = measured.sort_values(list(measured.columns), kind="stable")
    target = measured.pop("label").to_numpy(float)
    return fit_rules({n: measured[n].to_numpy(float) for n in measured}, target)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, in one projection."""
    texts = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    scored = with_statistics(texts, "doc_id").select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    names = docs.columns
    texts = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), text_of(docs).alias("text"))
    return with_statistics(texts, "__row").where(model.column() >= threshold).select("__row.*")
