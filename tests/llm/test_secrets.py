"""Secret scans against plain searches of every text with every expression."""

import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartflow.llm import queries, secrets
from cartflow.llm.secrets import RULES, Postings, Rule, Scanner, trigram_query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def plain(text):
    """The base spans (start, kind, end), as they are defined."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16])


def every(text, rules=RULES):
    return sorted((a, place, b) for place, rule in enumerate(rules) for a, b in rule.spans(text))


def told(spans):
    return ",".join(f"{RULES[p].kind}:{a}:{b}" for a, p, b in spans)


def check(row, text):
    base = plain(text)
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert row.base_sha256 == sha256(told(base).encode()).hexdigest() and row.base_spans == told(base)
    assert row.spans == told(every(text))


def test_the_whole_table(spark, sample):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    rows = queries.op12_trigram_secrets(spark, sample).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for row in rows:
        check(row, texts[row.doc_id] or "")
    assert sum(r.n_assign for r in rows)


PIECES = [
    "password", "PassWD", "secret", "toKen", "api_key", "apikey", "APIKEY", '"', "'", " ", "  ", ":", "=", "\n", "AKIA", "akia",
    "abcdef0123", "0123456789abcdef", "ABCDEFGHIJ0123", "token=secret=longenough", "é", "ſecret", "toKen", "-", "x" * 12,
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-" + "1" * 12, "https://me:pass@", "eyJ" + "a" * 10 + ".",
    "Authorization: Bearer " + "b" * 20, "日本", "\U0001f600",
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=8))
def test_random_blocks(texts):
    found = Scanner().spans(texts)
    for text, spans in zip(texts, found, strict=True):
        assert spans == every(text)
        assert [s for s in spans if s[1] < 3] == plain(text)


QUERY_PATTERNS = [
    r"abc(def|ghi)+jk?l", r"(?:foo|ba[rz])\d{2}qux", r"[abc]{4}end", r"x{5}y*z", r"(a|bc|def)(ghij|k)", r"(?i:Key)\s*=\s*\w+",
    r"pre.*post", r"(one)?two(three){2,}", r"[^a]bcd", r"été[éè]x", r"^start\b.{3}stop$", r"(ab|c)*defg", r"a(?:bc){0}defgh",
]


@pytest.mark.parametrize("pattern", [*QUERY_PATTERNS, *(r.pattern for r in RULES)])
def test_no_match_escapes_its_query(pattern):
    rule = Rule("any", pattern)
    query, scanner = trigram_query(rule), Scanner((rule,))

    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(rule.expression), st.from_regex(rule.expression))
    def holds(a, b):
        texts = [a, "nothing here", b]
        postings = Postings([secrets.folded(t) for t in texts], scanner.wanted)
        assert {0, 2} <= set(postings.texts(query).tolist())

    holds()


def test_queries_of_expressions():
    grams = lambda p: trigram_query(Rule("any", p)).grams()
    assert grams(r"abcd\d*efg") == {b"abc", b"bcd", b"efg"}
    assert grams(r"a[bc]d") == {b"abd", b"acd"}
    assert grams(r"\d*AKIA") == {b"aki", b"kia"}
    assert trigram_query(Rule("hex", "[0-9a-f]+")).everything
    assert trigram_query(Rule("any", "abcd|x?")).everything
    alternatives = trigram_query(Rule("any", "password|token"))
    assert alternatives.kind == "any" and all(p.kind == "all" for p in alternatives.parts)


def test_only_candidates_are_searched():
    scanner = Scanner((Rule("access", r"AKIA[A-Z0-9]{14,}"), Rule("word", "password=[a-z]+")))
    texts = ["plain words only"] * 500 + ["AKIA" + "Z" * 16, "the password=abc", "pass the word"]
    assert [i for i, s in enumerate(scanner.spans(texts)) if s] == [500, 501]
    assert scanner.searched == 2


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = secrets.scan(odd_docs).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert len(rows) == 12
    for row, text in zip(sorted(rows, key=lambda r: r.spans), sorted(texts, key=lambda t: told(every(t))), strict=True):
        check(row, text)
    assert secrets.scan(no_docs).count() == 0
    long = "word " * 2_000_000 + "AKIA" + "B" * 20
    (row,) = secrets.scan(spark.createDataFrame([(None, long)], "doc_id long, text string")).collect()
    assert (row.doc_id, row.spans) == (None, "access:10000000:10000024")
