"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.llm import (
    bpe,
    clustering,
    decontam,
    language,
    maxscore,
    near_dedup,
    quality_rules,
    secrets,
    spelling,
    substring_dedup,
    token_count,
    toxicity,
    wavelet,
)
from cartflow.llm.common import table
from cartflow.session import scratch_path


def op1_wavelet_tokens(spark: SparkSession, folder: str) -> DataFrame:
    shards = scratch_path(spark, "wavelet")
    manifest = wavelet.write_shards(table(spark, folder, "documents"), shards)
    return wavelet.read_documents(manifest, shards, keep_ids=False)


def op2_subword_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model)


def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), keep_ids=False)


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op6_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "covered")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"))


def op8_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, folder, "embeddings"))
    return maxscore.search(vectors, vectors.where(F.col("vec_id") % maxscore.EVERY == 0))


def op9_byte_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit_language(docs))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_rules.fit_quality(docs, table(spark, folder, "labels"))
    return quality_rules.score_quality(docs, model)


def op11_ns_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.clusters(clustering.quantised(table(spark, folder, "embeddings")))


def op12_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op13_trie_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wavelet_tokens,
        op2_subword_toxicity,
        op3_bpe_round_trip,
        op4_order_minhash,
        op5_sentence_spans,
        op6_template_decontamination,
        op7_token_counts,
        op8_maxscore,
        op9_byte_language,
        op10_quality_rules,
        op11_ns_bounds,
        op12_trigram_secrets,
        op13_trie_variants,
    )
}


def clusters_sql(rounds: int = clustering.ROUNDS) -> str:
    """Plain rounds over all pairs of a vector and a centroid; a distance and its centroid are ordered as one number."""
    steps = [
        """kept AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (
          SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS cluster, v
          FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS place, v FROM kept ORDER BY place LIMIT 16))"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS (
          SELECT vec_id, v, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)
            AS BIGINT) * 16 + cluster) AS best
          FROM kept, (SELECT cluster, v AS c FROM c{n}) GROUP BY vec_id, v)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
          SELECT cluster, list(mean ORDER BY pos) AS v
          FROM (SELECT best % 16 AS cluster, pos, floor(sum(v[pos]) / count(*)) AS mean
            FROM a{n}, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2) GROUP BY cluster),
        c{n + 1} AS (SELECT c{n}.cluster, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(best % 16 AS INTEGER) AS cluster, best // 16 AS distance,
          CAST(sum(best // 16) OVER (PARTITION BY best % 16) AS BIGINT) AS cluster_inertia,
          CAST(sum(best // 16) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON best % 16 = c.cluster"""


# SQL cannot express tokenizers, learned models or edit distances over word sequences; those queries are tested
# against brute force, other libraries or held-out labels in tests/llm.
ORACLE_SQL = {
    "op11_ns_bounds": clusters_sql(),
    "op8_maxscore": """
        WITH usable AS (
          SELECT CAST(vec_id AS BIGINT) AS vec_id,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank, vec_id, score FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM scored)
        WHERE rank <= 5""",
}
