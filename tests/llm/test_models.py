"""Learned operators: held-out accuracy, folds, and defined results for odd rows."""

import math
import re
import unicodedata
from zlib import crc32

import numpy as np
import pytest

from cartflow.llm import language, quality_rules, queries, toxicity

LARGER = "/root/testdata/sf0.1"


def fold(doc_id, modulus):
    return crc32(str(doc_id).encode()) % modulus


def held_out(rows, name, labels):
    kept = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.array([r[name] for r in kept]), np.array([labels[r.doc_id] for r in kept])


@pytest.fixture(scope="module")
def truth(spark):
    return spark.read.parquet(f"{LARGER}/labels.parquet").toPandas().set_index("doc_id")


def area(score, label):
    ranks = np.empty(len(score))
    ranks[np.argsort(score)] = np.arange(len(score))
    ones = label.sum()
    return (ranks[label == 1].sum() - ones * (ones - 1) / 2) / ones / (len(label) - ones)


@pytest.mark.parametrize(
    "query, name, threshold, least",
    [(queries.op10_quality_rules, "quality", 0.3, 0.97), (queries.op2_subword_toxicity, "toxic", 0.5, 0.9)],
)
def test_held_out_scores(spark, truth, query, name, threshold, least):
    rows = query(spark, LARGER).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 10_000
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= threshold) for r in rows)
    score, label = held_out(rows, "score", truth[name].to_dict())
    assert area(score, label) > least
    assert ((score >= threshold) == label).mean() > least


def test_held_out_languages(spark, sample):
    rows = queries.op9_byte_language(spark, sample).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    found, lang = held_out(rows, "lang_pred", langs)
    assert len(rows) == len(langs) and (found == lang).mean() > 0.97


def test_odd_rows(odd_docs, labels):
    scored = quality_rules.score_quality(odd_docs, quality_rules.fit_quality(odd_docs, labels)).collect()
    toxic = toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(odd_docs, labels)).collect()
    named = language.identify(odd_docs, language.fit_language(odd_docs)).collect()
    for rows in (scored, toxic, named):
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
        texts = [r.score for r in rows if r.doc_id in (3, 4)]
        assert texts[0] == texts[1]  # null and empty are the same
    assert {r.lang_pred for r in named if r.doc_id in (3, 4, 5)} == {language.UNKNOWN}


def test_nothing_to_learn_from(odd_docs, no_docs, labels):
    none = labels.limit(0)
    for model, score in (
        (quality_rules.fit_quality(odd_docs, none), quality_rules.score_quality),
        (toxicity.fit_toxicity(odd_docs, none), toxicity.score_toxicity),
    ):
        assert {r.score for r in score(odd_docs, model).collect()} == {0.5}
        assert score(no_docs, model).count() == 0
    model = language.fit_language(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, model).collect()} == {language.UNKNOWN}
    assert language.identify(no_docs, model).count() == 0


def test_the_filter_keeps_all_columns(odd_docs, labels):
    model = quality_rules.RuleModel(10.0)
    kept = quality_rules.keep_good(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == 12
    assert quality_rules.keep_good(odd_docs, quality_rules.RuleModel(-10.0)).count() == 0


def test_filters_do_not_measure_again(odd_docs):
    """The statistics of a text stand once in the plan, whatever the number of rules; their split of words twice."""
    rules = [((quality_rules.Condition("distinct_words", True, i / 50),), 0.1) for i in range(40)]
    model = quality_rules.RuleModel(0.0, rules)
    for df in (quality_rules.keep_good(odd_docs, model), quality_rules.score_quality(odd_docs, model).where("score > 0.5")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_distinct") == 2
        df.collect()


def test_the_column_equals_the_rules(spark, sample, truth):
    """Scores of the Spark expression against a plain loop over rules and texts."""
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    model = quality_rules.fit_quality(docs, spark.read.parquet(f"{sample}/labels.parquet"))
    assert model.rules

    def measure(text):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.strip(" "))]
        lines, chars = text.split("\n"), max(1, len(text))
        kinds = [unicodedata.category(c) for c in text]
        letters = [k[0] == "L" or k[0] == "N" for k in kinds]
        return {
            "words": math.log1p(len(words)),
            "word_length": chars / len(words),
            "distinct_words": len(set(words)) / len(words),
            "distinct_lines": len(set(lines)) / len(lines),
            "upper": kinds.count("Lu") / chars,
            "digits": sum(k[0] == "N" for k in kinds) / chars,
            "symbols": sum(not a and c not in " \t\n\x0b\f\r.,'’" for a, c in zip(letters, text, strict=True)) / chars,
        }

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in quality_rules.score_quality(docs, model).collect():
        values, total = measure(texts[row.doc_id]), model.bias
        for rule, weight in model.rules:
            if all(values[c.name] > c.cut if c.above else values[c.name] <= c.cut for c in rule):
                total += weight
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_rules_find_a_conjunction():
    random = np.random.default_rng(0)
    values = {"a": random.random(3000), "b": random.random(3000), "c": random.random(3000)}
    label = ((values["a"] > 0.5) & (values["b"] <= 0.3)).astype(float)
    model = quality_rules.fit_rules(values, label)
    score = np.full(3000, model.bias)
    for rule, weight in model.rules:
        score += weight * np.logical_and.reduce([c.holds(values) for c in rule])
    assert ((score > 0) == label).mean() > 0.99
    assert 0 < len(model.rules) < 60


def test_misspellings_share_vectors():
    random = np.random.default_rng(3)
    words = ["".join(random.choice(list("aeiourstln"), 6)) for _ in range(300)]
    texts = [" ".join(random.choice(words, 30)) for _ in range(400)]
    label = np.arange(400) % 2
    texts = [t + " zblorgquix" * 2 if y else t for t, y in zip(texts, label, strict=True)]
    score = toxicity.fit_bags(toxicity.bags(texts), label.astype(float)).scorer()
    clean = " ".join(words[:30])
    assert score(clean) < 0.5 < score(clean + " zblorgquiz zblorqquix")


def test_folded_tables_equal_the_convolution():
    random = np.random.default_rng(2)
    texts = ["".join(random.choice(list("abcdeé"), 300)) for _ in range(40)]
    cut = [language.windows(t.encode())[:1] for t in texts]
    net = language.fit_net(np.concatenate(cut), ["x", "y"] * 20, epochs=1)
    rows = language.windows(texts[0].encode())
    padded = np.pad(rows, ((0, 0), (0, 3)))
    vectors = net.weights["bytes"][padded]
    pooled = []
    for w in language.WIDTHS:
        kernel = net.weights[f"filter{w}"]
        pooled.append(sum(vectors[:, j : j + language.WINDOW] @ kernel[j] for j in range(w)).max(1))
    hidden = np.maximum(np.concatenate(pooled, 1) + net.weights["bias"], 0)
    plain = hidden @ net.weights["dense"] + net.weights["dense_bias"]
    assert np.allclose(plain, net.logits(rows), atol=1e-4)


def test_scores_equal_plain_loops(spark, sample):
    """Toxicity and language of whole texts with the learned numbers, word by word and byte by byte."""
    docs = spark.read.parquet(f"{sample}/documents.parquet").where("doc_id % 25 = 0")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sample}/labels.parquet"))
    for row in toxicity.score_toxicity(docs, model).collect():
        at = [b for word in re.findall(r"\w+", texts[row.doc_id].lower()) for b in toxicity.subwords(word)]
        total = model.bias + sum(model.logits[b] for b in at) / max(1, len(at))
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
    net = language.fit_language(spark.read.parquet(f"{sample}/documents.parquet"), rows=300)
    weights = net.weights
    shortest = sorted(texts, key=lambda i: len(texts[i]))[:8]
    named = {r.doc_id: r for r in language.identify(docs, net).collect()}
    for doc_id in shortest:
        raw, logits = texts[doc_id].encode(), []
        for start in range(0, max(1, len(raw)), 128):
            cut = list(raw[start : start + 128])
            cut += [0] * (131 - len(cut))
            pooled = []
            for w in language.WIDTHS:
                kernel = weights[f"filter{w}"]
                sums = [sum(weights["bytes"][cut[i + j]] @ kernel[j] for j in range(w)) for i in range(128)]
                pooled.append(np.max(sums, 0))
            hidden = np.maximum(np.concatenate(pooled) + weights["bias"], 0)
            logits.append(hidden @ weights["dense"] + weights["dense_bias"])
        mean = np.mean(np.array(logits, float), 0)
        chance = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert named[doc_id].lang_pred == net.languages[int(chance.argmax())]
        assert named[doc_id].score == pytest.approx(chance.max(), rel=1e-3)


def test_all_parts_of_a_text_are_learned_from(spark):
    """The only toxic word, and the only letters of a language, stand at the end of long texts."""
    filler = "plain words go on and on " * 900
    rows = [(i, filler + ("zblorgquix" if i % 2 else "harmless"), "xy"[i % 2]) for i in range(1, 121)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    bags = toxicity.sampled_bags(quality_rules.labelled(docs, labels, "toxic", 5, 1_000)).collect()
    word = toxicity.subwords("zblorgquix")[0]
    assert bags and all((word in np.frombuffer(r["at"], np.int32)) == (r.label == 1) for r in bags)
    model = toxicity.fit_bags([(np.frombuffer(r["at"], np.int32), np.frombuffer(r.share, np.float32)) for r in bags], np.array([r.label for r in bags]))
    assert model.scorer()("zblorgquix") > model.scorer()("harmless")
