"""Spelling variants against plain counting and one-edit neighbourhoods."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from cartflow.llm import queries, spelling


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain(counts):
    """(word, n, n_near, form, form_n, root) from all deletions and replacements of single characters."""
    holes = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            holes[word[:i] + "\0" + word[i + 1 :]].add(word)
            holes[word[:i] + word[i + 1 :]].add(word)
    near = {w: set() for w in counts}
    for key, group in holes.items():
        if "\0" in key:
            for word in group:
                near[word] |= group - {word}
        elif key in counts:
            near[key] |= group
            for word in group:
                near[word].add(key)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None
    out = set()
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, n, len(near[word]), form[word], counts.get(form[word]), root))
    return out


def told(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_the_whole_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").collect()
    expected = plain(plain_counts([(r.doc_id, r.text) for r in docs]))
    assert told(queries.op13_trie_variants(spark, sample)) == expected
    assert sum(r[3] is not None for r in expected) > 50


@pytest.mark.parametrize("seed, letters, longest", [(1, "ab", 10), (2, "abcé", 9), (3, "abcdefgh", 12)])
def test_dense_words(spark, seed, letters, longest):
    """Few letters, so that nearly every word has neighbours of all three kinds; counts differ by powers of ten."""
    random = np.random.default_rng(seed)
    words = ["".join(random.choice(list(letters), random.integers(6, longest + 1))) for _ in range(150)]
    for word in words[:60]:
        at = int(random.integers(0, len(word)))
        words += [word[:at] + word[at + 1 :], word[:at] + "z" + word[at:], word[:at] + "y" + word[at + 1 :]]
    rows = [(i, " ".join([w] * int(random.choice([1, 2, 3, 30, 400])))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(plain_counts(rows))
    assert told(spelling.variants(docs)) == expected and any(r[2] > 1 for r in expected)


def test_chains_of_forms_and_long_words(spark):
    long = "ab" * 3_000
    chain = {"aaaaaaaa": 3, "aaaaaaab": 45, "aaaaaabb": 600, "aaaaabbb": 8_000}
    words = {**chain, long: 30, long[:2_000] + "c" + long[2_000:]: 2, long[:-1] + "z": 3, long + "q" * 50: 2}
    words |= {"a" * n: 2 for n in range(9, 40)}
    rows = [(i * 10_000 + k, word) for i, (word, n) in enumerate(words.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(plain_counts(rows))
    got = told(spelling.variants(docs))
    assert got == expected
    assert dict((r[0], r[5]) for r in got)["aaaaaaaa"] == "aaaaabbb"


def test_counts_are_handed_on(monkeypatch, spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    expected = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    assert {r.word: r.n for r in spelling.counted(docs).collect()} == expected


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert told(spelling.variants(odd_docs)) == plain(plain_counts(rows))
    assert told(spelling.variants(no_docs)) == set()
    none = spark.createDataFrame([(1, None), (2, ""), (None, "short words only")], "doc_id long, text string")
    assert told(spelling.variants(none)) == set()
