"""MaxScore against the full product, and the pipeline against its stages by brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartflow.llm import bpe, maxscore, queries
from compare import connect, differences
from test_dedup import plain_removal


def brute(vectors, every, k):
    usable = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors]
    out = set()
    for q, x in usable:
        if q % every == 0:
            scores = [(-int(x @ y), i) for i, y in usable if i != q]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows, block", [(maxscore.SHARD_ROWS, maxscore.BLOCK_QUERIES), (60, 3)])
def test_the_whole_table(spark, sample, shard_rows, block):
    table = spark.read.parquet(f"{sample}/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in table.collect()], 50, 5)
    vectors = maxscore.quantised(table)
    found = maxscore.search(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=shard_rows, block=block)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()} == expected
    if block == maxscore.BLOCK_QUERIES:
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op8_maxscore(spark, sample).collect()} == expected


def test_the_query_equals_sql(spark, sample):
    found = queries.op8_maxscore(spark, sample)
    assert differences(found, queries.ORACLE_SQL["op8_maxscore"], connect(sample)) == []


def test_sparse_vectors_ties_and_chunks(spark, monkeypatch):
    random = np.random.default_rng(1)
    dense = random.integers(-3, 4, (700, 12)) * (random.random((700, 12)) < 0.3)
    rows = [(int(i), [float(x) / 256 for x in v]) for i, v in enumerate(dense)]
    monkeypatch.setattr(maxscore, "CHUNK", 16)
    values = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    postings = maxscore.Postings(np.arange(700), values)
    expected = brute(rows, 50, 5)
    got = {(q, n, i, s) for q in range(0, 700, 50) for n, (s, i) in enumerate(postings.top(values[q], q, 5), 1)}
    assert got == expected


@pytest.mark.parametrize("widest", [3, 5_000, 10**8])
def test_a_block_of_queries_at_once(monkeypatch, widest):
    """Lists of all lengths, values beyond what narrow floats hold, repeated ids, queries of another length."""
    random = np.random.default_rng(widest)
    monkeypatch.setattr(maxscore, "CHUNK", 16)
    values = random.integers(-widest, widest + 1, (200, 8)) * (random.random((200, 8)) < np.linspace(0.1, 1, 8))
    ids, asked, own = random.integers(0, 150, 200), random.integers(-widest, widest + 1, (40, 6)), random.integers(0, 150, 40)
    place, vec_id, score = maxscore.Postings(ids, values).top_each(asked, own, 5)
    for n, (query, me) in enumerate(zip(asked.tolist(), own.tolist(), strict=True)):
        scores = sorted((-sum(q * x for q, x in zip(query, v, strict=False)), i) for v, i in zip(values.tolist(), ids.tolist(), strict=True) if i != me)
        assert list(zip((-score[place == n]).tolist(), vec_id[place == n].tolist(), strict=True)) == scores[:5]


def test_rows_are_not_copied_for_every_block(spark, sample):
    vectors = maxscore.quantised(spark.read.parquet(f"{sample}/embeddings.parquet"))
    found = maxscore.search(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=100, block=2)
    plan = found._jdf.queryExecution().analyzed().toString()
    # 500 rows in 5 shards, 10 queries in 5 blocks: the queries go to every shard, the rows are copied once.
    assert sorted(re.findall(r"sequence\(0, (\d+)", plan)) == ["0", "4"]


def test_zero_rows_beat_a_negative_score(monkeypatch):
    monkeypatch.setattr(maxscore, "CHUNK", 4)
    values = np.concatenate((np.arange(1, 25).reshape(8, 3), np.zeros((4, 3)))).astype(np.int64)
    postings = maxscore.Postings(np.arange(12), values)
    assert postings.top(np.array([-1, -2, -1]), 99, 3) == [(0, 8), (0, 9), (0, 10)]


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, []), (4, [0.5, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    vectors = maxscore.quantised(table)
    found = maxscore.search(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(8, 128 * 256), (1, 128**2 + 64**2), (1, 128**2 + 64**2), (7, -128 * 256)]
    assert maxscore.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_stages_and_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "good_quality",
        "near_duplicates",
        "repeated_passages",
        "benchmark_leaks",
        "token_ids",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_its_parts(spark, sample):
    """Each stage's decisions taken from its query over the same rows, applied with plain Python."""
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in queries.op10_quality_rules(spark, sample).collect() if r.predicted}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, sample)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    second = stages["near_duplicates"](spark, first, sample)
    kept = sorted(r.doc_id for r in second.collect())
    from cartflow.llm import near_dedup

    assert kept == sorted({r.class_id for r in near_dedup.classes(first).collect()})
    shortened = dict(zip(kept, plain_removal([rows[i] for i in kept]), strict=True))
    items = [r.text.split() for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    leaks = {i for i in kept if any(" ".join(b) in " ".join(shortened[i]) for b in items)}
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sample).collect()}
    assert final.keys() == set(kept) - leaks
    for r in final.values():
        text = bpe.encoder(bpe.public_tokenizers.path(bpe.RANKS)).decode(bytes(r.ids))
        assert text.decode().split() == shortened[r.doc_id] and r.n_tokens == len(r.ids) // 4
        assert hashlib.sha256(text).hexdigest() == r.decoded_sha256


def test_pipeline_on_odd_and_empty_documents(spark, odd_docs, no_docs, labels, tmp_path):
    items = spark.createDataFrame([(1, "a text of some words"), (2, None)], "item_id long, text string")
    for docs, name in ((odd_docs, "odd"), (no_docs, "none")):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
