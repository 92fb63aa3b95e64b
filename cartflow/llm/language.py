"""Language identification by a convolutional network over bytes.

Byte vectors, filters of several widths, max pooling over a fixed-length window and a softmax, trained in numpy. A
text is cut into windows from end to end; the window scores are averaged. For prediction the byte vectors are folded
into the filters, so a convolution is a sum of table rows looked up by byte pairs.

Defined cases: a null text, an empty one and one without letters give `und` with score 0; texts of any length are
read whole; every row gives a row, repeated or not; a null id stays null, is never learned from and has a null
`held_out`; null languages are skipped; with nothing to learn from every prediction is `und`; an empty table gives no
rows; columns other than `doc_id`, `text` and, for learning, `lang` are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import per_batch, remainder, text_of

SAMPLE_WINDOWS = 6_000  # about so many windows of each language are learned from, out of all windows of all texts
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
VECTOR = 8


def windows(text: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled up with zeros."""
    rows = max(1, -(-len(text) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class ByteNet:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights}  # tasks fold the tables themselves

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair adds to every filter as first two bytes, and to the wider ones as third and fourth."""
        byte = self.weights["bytes"]
        single = {w: np.einsum("bv,wvf->wbf", byte, self.weights[f"filter{w}"]) for w in WIDTHS}
        first = [(single[w][0][:, None] + single[w][1][None]).reshape(65536, FILTERS) for w in WIDTHS]
        third = np.repeat(single[3][2], 256, axis=0)
        both = (single[4][2][:, None] + single[4][3][None]).reshape(65536, FILTERS)
        return np.concatenate(first, 1), np.concatenate([third, both], 1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Scores per window. Positions where a filter would leave the window read zeros."""
        pairs, later = self.tables
        weights = self.weights
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), 128):
            part = np.pad(rows[at : at + 128], ((0, 0), (0, 3))).astype(np.uint16)
            pair = part[:, :-1] << np.uint16(8) | part[:, 1:]
            found = pairs[pair[:, :WINDOW]]
            found[:, :, FILTERS:] += later[pair[:, 2:]]
            pooled = np.maximum(found.max(1) + weights["bias"], 0)
            out[at : at + 128] = pooled @ weights["dense"] + weights["dense_bias"]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known or not self.languages:
            return names, scores
        rows = [windows(texts[i].encode("utf-8")) for i in known]
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        logits = self.logits(np.concatenate(rows)).astype(float)
        mean = np.add.reduceat(logits, starts) / np.array([len(r) for r in rows])[:, None]
        chance = np.exp(mean - mean.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        for i, best, row in zip(known, chance.argmax(1), chance, strict=True):
            names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def fit_net(rows: np.ndarray, langs: list[str], epochs: int = 4, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on the cross-entropy of single windows; the gradient of a max pool goes to its winning position."""
    languages = sorted(set(langs))
    random = np.random.default_rng(seed)
    data, target = np.pad(rows, ((0, 0), (0, 3))), np.array([languages.index(x) for x in langs], int)
    values = {"bytes": random.normal(0, 0.3, (256, VECTOR))}
    for w in WIDTHS:
        values[f"filter{w}"] = random.normal(0, 1 / np.sqrt(w * VECTOR), (w, VECTOR, FILTERS))
    values["bias"] = np.zeros(FILTERS * len(WIDTHS))
    values["dense"] = random.normal(0, 0.2, (FILTERS * len(WIDTHS), max(1, len(languages))))
    values["dense_bias"] = np.zeros(max(1, len(languages)))
    values = {k: v.astype(np.float32) for k, v in values.items()}
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    steps = 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(data)), max(1, len(data) // 64)):
            if not batch.size:
                continue
            x, pooled, best = data[batch], [], []
            vectors = values["bytes"][x]
            for w in WIDTHS:
                kernel = values[f"filter{w}"]
                found = sum(vectors[:, j : j + WINDOW] @ kernel[j] for j in range(w))
                best.append(found.argmax(1))
                pooled.append(np.take_along_axis(found, best[-1][:, None], 1)[:, 0])
            before = np.concatenate(pooled, 1) + values["bias"]
            hidden = np.maximum(before, 0)
            score = hidden @ values["dense"] + values["dense_bias"]
            chance = np.exp(score - score.max(1, keepdims=True))
            error = chance / chance.sum(1, keepdims=True)
            error[np.arange(len(batch)), target[batch]] -= 1
            error /= len(batch)
            slopes = {"dense": hidden.T @ error, "dense_bias": error.sum(0), "bytes": np.zeros_like(values["bytes"])}
            back = (error @ values["dense"].T) * (before > 0)
            slopes["bias"] = back.sum(0)
            line = np.arange(len(batch))[:, None]
            for k, w in enumerate(WIDTHS):
                mine, kernel = back[:, k * FILTERS : (k + 1) * FILTERS], values[f"filter{w}"]
                slopes[f"filter{w}"] = np.empty_like(kernel)
                for j in range(w):
                    at = x[line, best[k] + j]
                    slopes[f"filter{w}"][j] = np.einsum("bfv,bf->vf", values["bytes"][at], mine)
                    np.add.at(slopes["bytes"], at, mine[:, :, None] * kernel[j].T[None])
            steps += 1
            for name, slope in slopes.items():
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope**2 - second[name])
                values[name] -= rate * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.999**steps)) + 1e-8)
    return ByteNet(languages, values)


def fit_language(docs: DataFrame, rows: int = SAMPLE_WINDOWS) -> ByteNet:
    """Learn from about `rows` windows of each language. A window is chosen by a hash of its document and its number,
    so that every part of every text may be learned from, and a long text gives no more than its share."""
    usable = docs.select(docs["doc_id"], docs["lang"], text_of(docs).alias("text"))
    usable = usable.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    count = F.ceil(F.octet_length("text") / WINDOW)
    # One number per language, as many as the model has outputs.
    counts = usable.groupBy("lang").agg(F.sum(count).alias("n")).collect()
    if not counts:
        return fit_net(np.zeros((0, WINDOW), np.uint8), [])
    slots = 1 << 40
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(slots, -(-slots * rows // r["n"]))))])
    slot = lambda i: F.pmod(F.xxhash64(F.lit("window"), "doc_id", i), F.lit(slots))
    numbers = F.sequence(F.lit(0), (count - 1).cast("int"))
    limited = usable.withColumn("limit", F.element_at(share, F.col("lang")))
    chosen = limited.select("doc_id", "lang", "text", F.filter(numbers, lambda i: slot(i) < F.col("limit")).alias("at"))

    def make():
        def step(rows: dict) -> dict:
            cut = [windows(t.encode("utf-8"))[at].tobytes() for t, at in zip(rows["text"], rows["at"], strict=True)]
            return {"doc_id": rows["doc_id"], "lang": rows["lang"], "windows": cut}

        return step

    # Texts without a chosen window stay in the JVM.
    some = chosen.where(F.size("at") > 0).select("doc_id", "lang", "text", "at")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = per_batch(some, make, f"doc_id {kind}, lang string, windows binary").toPandas().sort_values(["doc_id", "windows"])
    cut = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in got["windows"]]
    langs = [lang for lang, x in zip(got["lang"], cut, strict=True) for _ in range(len(x))]
    return fit_net(np.concatenate(cut), langs) if cut else fit_net(np.zeros((0, WINDOW), np.uint8), [])


def identify(docs: DataFrame, model: ByteNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document, without a shuffle."""

    def make():
        def step(rows: dict) -> dict:
            names, scores = model.predict(rows["text"])
            return {"doc_id": rows["doc_id"], "lang_pred": names, "score": scores}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = per_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double")
    held_out = (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return named.select("doc_id", held_out, "lang_pred", "score")
