"""Token shards, encoding and counting against the libraries, on whole tables and on odd texts."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from cartflow.llm import bpe, queries, token_count, wavelet
from cartflow.session import scratch_path

ALPHABET = " \n\t    ab1'sé日本\U0001f600._▁x<s>r\x1c 　"


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def odd_texts():
    rng = random.Random(1)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*some, "", " ", "   ", " a", "\n \n x", "a" * 4000, "ab" * 6000, "<|endoftext|> <s></s><unk>", "日本語 テキスト  日"]


@pytest.fixture(scope="module")
def rank_library():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def json_library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(wavelet.MODEL))


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_count.MODEL))


def test_encoder_equals_the_library(rank_library):
    own = bpe.encoder(public_tokenizers.path(bpe.RANKS))
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == packed(rank_library.encode_ordinary(text)), text
        assert own.decode(ids) == text.encode()
    assert not any(own.leaves)


def test_counter_equals_the_library(piece_library):
    own = token_count.Counter(public_tokenizers.path(token_count.MODEL))
    for text in odd_texts():
        assert own.count(text) == len(piece_library.encode(text)), text


def test_units_equal_whole_texts(json_library):
    own = wavelet.Tokenizer(public_tokenizers.path(wavelet.MODEL))
    texts = odd_texts()
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids == packed(json_library.encode(text, add_special_tokens=False).ids), text


def test_small_memos_change_nothing(rank_library):
    own = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    own.memo.limit = own.merged.limit = 2
    for text in odd_texts()[:300]:
        assert own.encode(text) == packed(rank_library.encode_ordinary(text))


@pytest.mark.parametrize("size, high", [(0, 5), (1, 1), (70_000, 50_257), (90_000, 7), (1000, 1 << 20)])
def test_wavelet_matrix(size, high):
    ids = np.random.default_rng(1).integers(0, high, size).astype(np.uint32)
    shard = wavelet.open_bytes(wavelet.pack_shard(ids, [3, None], np.array([size // 2, size])))
    assert (shard.matrix.ids() == ids).all() and shard.doc_ids == [3, None]
    for at in {0, size // 2, size - 1} & set(range(size)):
        assert shard.matrix.access(at) == ids[at]
    for token in {*ids[:3].tolist(), high - 1, 1 << 22}:
        assert shard.matrix.count(token) == (ids == token).sum()
        assert shard.matrix.count(token, size // 3) == (ids[: size // 3] == token).sum()
        assert (shard.matrix.positions(token) == np.flatnonzero(ids == token)).all()


def test_a_foreign_file_is_refused():
    with pytest.raises(ValueError):
        wavelet.Shard(io.BytesIO(b"something else"))


def shards_of(docs, **options):
    folder = scratch_path(docs.sparkSession, "shards")
    return wavelet.write_shards(docs, folder, **options), folder


def in_order(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))


@pytest.mark.parametrize("shard_tokens", [50, wavelet.SHARD_TOKENS])
def test_shards_of_odd_documents(odd_docs, json_library, shard_tokens):
    manifest, folder = shards_of(odd_docs, shard_tokens=shard_tokens)
    got = sorted(wavelet.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    at, whole = 0, []
    for row, doc in zip(got, in_order(odd_docs), strict=True):
        ids = [*json_library.encode(doc.text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc.doc_id, at, len(ids), packed(ids))
        assert row.ids_crc32 == zlib.crc32(packed(ids))
        at += len(ids)
        whole += ids
    token = max(set(whole), key=whole.count)
    found = sorted(r.position for r in wavelet.occurrences(manifest, folder, token).collect())
    assert found == [i for i, x in enumerate(whole) if x == token]
    counts = {r.token: r.n for r in wavelet.token_counts(manifest, folder, [token, 0, 49_999]).collect()}
    assert counts == {t: whole.count(t) for t in (token, 0, 49_999)}


def test_empty_tables(no_docs):
    manifest, folder = shards_of(no_docs)
    assert manifest.count() == wavelet.read_documents(manifest, folder).count() == 0
    for frame in (bpe.encode_documents(no_docs), token_count.count_tokens(no_docs)):
        assert frame.count() == 0


def test_odd_documents_encode_and_count(odd_docs, rank_library, piece_library):
    texts = sorted((r.text or "" for r in odd_docs.select("text").collect()))
    encoded = bpe.encode_documents(odd_docs)
    assert sorted(r.text for r in bpe.decode_ids(encoded).collect()) == texts
    expected = sorted(hashlib.sha256(packed(rank_library.encode_ordinary(t))).hexdigest() for t in texts)
    assert sorted(r.ids_sha256 for r in encoded.collect()) == expected
    counts = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd_docs).collect())
    assert counts == sorted((len(t.encode()), n := len(piece_library.encode(t)), n > 4096) for t in texts)


def test_queries_on_the_whole_table(spark, sample, rank_library, json_library, piece_library):
    docs = spark.read.parquet(f"{sample}/documents.parquet").orderBy("doc_id").collect()
    at, tokens, encoded, counted = 0, [], [], []
    for d in docs:
        ids = [*json_library.encode(d.text, add_special_tokens=False).ids, 0]
        tokens.append((d.doc_id, at, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
        ids = rank_library.encode_ordinary(d.text)
        text = hashlib.sha256(d.text.encode()).hexdigest()
        encoded.append((d.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), text))
        n = len(piece_library.encode(d.text))
        counted.append((d.doc_id, len(d.text.encode()), n, n > 4096))
    for query, expected in (
        (queries.op1_wavelet_tokens, tokens),
        (queries.op3_bpe_round_trip, encoded),
        (queries.op7_token_counts, counted),
    ):
        assert sorted(tuple(r) for r in query(spark, sample).collect()) == expected


def test_long_units_are_not_remembered():
    long = "\u65e5\u672c" * 5_000
    bpe_encoder = bpe.Encoder(bpe.load_ranks(bpe.public_tokenizers.path(bpe.RANKS)))
    counter = token_count.Counter(token_count.public_tokenizers.path(token_count.MODEL))
    tokens = wavelet.Tokenizer(wavelet.public_tokenizers.path("byte_bpe_50k.json"))
    for text in (long, "QUJD" * 3_000, f"short words and {long} again"):
        first = bpe_encoder.encode(text), counter.count(text), tokens.encode_all([text])
        assert first == (bpe_encoder.encode(text), counter.count(text), tokens.encode_all([text]))
    for memo in (bpe_encoder.memo, bpe_encoder.merged, counter.memo, tokens.units, tokens.parts):
        assert max(map(len, [*memo, *memo.old])) <= memo.longest
