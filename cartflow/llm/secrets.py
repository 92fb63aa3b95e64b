"""Secret scans with a trigram index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is derived that every text with a
match must meet (AND along a sequence, OR over alternatives). Texts are indexed in blocks: the postings of a block list,
per trigram, the texts that hold it. A query intersects and unites postings, and only the texts it leaves are searched
with the expression. Rules without a mandatory trigram search every text. An index lives in the task that holds the
texts of its block, so neither texts nor postings travel, and a lost task builds its own blocks anew.

Trigrams are taken from UTF-8 bytes with A-Z folded to a-z, for rules of either case; the folding only lets more texts
through to the search. Expressions are compiled with `re.ASCII`, so that "either case" means these letters alone.

Defined cases: a null text counts as empty and has no spans; texts of any length are searched whole; every row gives a
row, repeated or not, and a null id stays null; an empty table gives no rows; columns other than `doc_id` and `text` are
not looked at.
"""

from __future__ import annotations

import re
import re._constants as op  # the parse trees of `re` have no public interface
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from cartflow.llm.common import per_batch, text_of

MOST_STRINGS = 32  # exact alternatives that a part of an expression may have before its trigrams are taken
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """`least` is the length that `group` of a match must have; a match that fails is dropped, its text is used up."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @cached_property
    def expression(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.expression.finditer(text) if len(m.group(self.group)) >= self.least]


# The three base kinds, in this order, and well-known credential formats. Runs of the classes of `access`
# and `hex` are maximal, so their least length can stand in the expression.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,})"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@"),
)
RULES = (*BASE, *MORE)


# --- Boolean queries ---


@dataclass(frozen=True)
class Query:
    """A trigram (`gram`), or the `all` / `any` of other queries. An empty `all` holds for every text."""

    kind: str
    gram: bytes = b""
    parts: frozenset = frozenset()

    @property
    def everything(self) -> bool:
        return self.kind == "all" and not self.parts

    def grams(self) -> set[bytes]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts))


EVERYTHING = Query("all")


def both(*queries: Query) -> Query:
    parts = frozenset().union(*(q.parts if q.kind == "all" else {q} for q in queries))
    return next(iter(parts)) if len(parts) == 1 else Query("all", parts=parts)


def either(queries: Iterable[Query]) -> Query:
    parts = frozenset(queries)
    if any(p.everything for p in parts):
        return EVERYTHING
    return next(iter(parts)) if len(parts) == 1 else Query("any", parts=parts)


def folded(text: str) -> bytes:
    return text.encode("utf-8").lower()


def grams_of(strings: Iterable[str]) -> Query:
    """Every text that holds one of the strings meets this query; a string below three bytes asks for nothing."""
    queries = []
    for raw in map(folded, strings):
        queries.append(both(*(Query("gram", raw[i : i + 3]) for i in range(len(raw) - 2))))
    return either(queries)


@dataclass
class Part:
    """What is known of the texts that a part of an expression matches.

    `exact`: all of them, or None if they are too many; else they begin with one of `first` and end with one of `last`.
    `query` holds for all of them besides.
    """

    exact: frozenset[str] | None
    first: frozenset[str] = field(default_factory=lambda: frozenset({""}))
    last: frozenset[str] = field(default_factory=lambda: frozenset({""}))
    query: Query = EVERYTHING


EMPTY = Part(frozenset({""}))
UNKNOWN = Part(None)


def bounded(part: Part) -> Part:
    """Too many exact texts become their trigrams, with what begins and ends them; ends are cut to two characters."""
    if part.exact is not None and len(part.exact) <= MOST_STRINGS:
        return part
    if part.exact is not None:
        part = Part(None, part.exact, part.exact, both(part.query, grams_of(part.exact)))

    def cut(ends: frozenset[str], shorten) -> frozenset[str]:
        ends = frozenset(map(shorten, ends))
        return ends if len(ends) <= MOST_STRINGS else frozenset({""})

    return Part(None, cut(part.first, lambda x: x[:2]), cut(part.last, lambda x: x[-2:]), part.query)


def joined(a: Part, b: Part) -> Part:
    """`a` followed by `b`."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 4 * MOST_STRINGS:
        return bounded(Part(frozenset(x + y for x in a.exact for y in b.exact), query=both(a.query, b.query)))
    ends, starts = (a.last if a.exact is None else a.exact), (b.first if b.exact is None else b.exact)
    middle = EVERYTHING
    if len(ends) * len(starts) <= 4 * MOST_STRINGS:
        middle = grams_of(x + y for x in ends for y in starts)
    single = [grams_of(p.exact) for p in (a, b) if p.exact is not None]
    first = a.first if a.exact is None else frozenset(x + y for x in a.exact for y in starts)
    last = b.last if b.exact is None else frozenset(x + y for x in ends for y in b.exact)
    return bounded(Part(None, first, last, both(a.query, b.query, middle, *single)))


def alternatives(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        return bounded(Part(frozenset().union(*(p.exact for p in parts)), query=either(p.query for p in parts)))
    whole = [p if p.exact is None else Part(None, p.exact, p.exact, both(p.query, grams_of(p.exact))) for p in parts]
    first, last = (frozenset().union(*(getattr(p, end) for p in whole)) for end in ("first", "last"))
    return bounded(Part(None, first, last, either(p.query for p in whole)))


def characters(items: list) -> frozenset[str] | None:
    """The characters of a class, or None for many or unknown ones."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    found = {folded(c).decode() for c in found}
    return frozenset(found) if len(found) <= MOST_STRINGS else None


def part_of(tree) -> Part:
    """The part for a parsed expression. Whatever is not known in detail is UNKNOWN, which asks for nothing."""
    out = EMPTY
    for kind, value in tree:
        if kind is op.LITERAL:
            step = Part(frozenset({folded(chr(value)).decode()}))
        elif kind is op.IN:
            chars = characters(value)
            step = UNKNOWN if chars is None else Part(chars)
        elif kind is op.SUBPATTERN:
            step = part_of(value[3])
        elif kind is op.BRANCH:
            step = alternatives([part_of(p) for p in value[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = part_of(inner)
            # The first repetitions are certain; after them comes anything, unless there can be no more.
            step = reduce(joined, [once] * min(low, 3), EMPTY)
            if (low, high) == (0, 1):
                step = alternatives([EMPTY, once])
            elif high > min(low, 3):
                step = joined(step, UNKNOWN)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            step = EMPTY
        else:
            step = UNKNOWN
        out = joined(out, step)
    return out


def trigram_query(rule: Rule) -> Query:
    """What every text with a match of the rule holds; everything, if the rule has no mandatory trigram."""
    part = part_of(parser.parse(rule.pattern, re.ASCII))
    return part.query if part.exact is None else both(part.query, grams_of(part.exact))


# --- index ---


class Postings:
    """The texts of one block by trigram, for the trigrams in `wanted` (a table of flags over all of them)."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        self.count = len(texts)
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        found = [np.zeros(0, np.uint64)]
        for start in range(0, data.size - 2, BLOCK_BYTES):
            part = data[start : start + BLOCK_BYTES + 2].astype(np.uint32)
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(wanted[codes])
            # A trigram across two texts is counted for the first one; the search then finds nothing there.
            holder = np.searchsorted(ends, start + at, side="right").astype(np.uint64)
            found.append(np.unique(codes[at].astype(np.uint64) << np.uint64(32) | holder))
        pairs = np.unique(np.concatenate(found))
        grams, holders = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keys, starts = np.unique(grams, return_index=True)
        self.lists = dict(zip(keys.tolist(), np.split(holders, starts[1:]), strict=bool(keys.size)))

    def texts(self, query: Query) -> np.ndarray:
        """The numbers of the texts that meet the query, ascending."""
        if query.kind == "gram":
            return self.lists.get(int.from_bytes(query.gram, "big"), np.zeros(0, np.int64))
        if query.everything:
            return np.arange(self.count)
        found = sorted((self.texts(p) for p in query.parts), key=len)
        if query.kind == "any":
            return np.unique(np.concatenate(found))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), found)


class Scanner:
    """Rules with their queries; `spans` searches a block of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.queries = rules, [trigram_query(r) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for gram in set().union(*(q.grams() for q in self.queries)):
            self.wanted[int.from_bytes(gram, "big")] = True
        self.searched = 0  # texts searched with an expression, for tests

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, place of the rule, end), by start and rule."""
        postings = Postings([folded(t) for t in texts], self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for place, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in postings.texts(query).tolist():
                self.searched += 1
                found[i] += [(start, place, end) for start, end in rule.spans(texts[i])]
        return [sorted(x) for x in found]


def blocks(texts: list[str], size: int = BLOCK_BYTES) -> Iterable[list[str]]:
    """The texts in order, in runs of about `size` characters; a longer text is a block of its own."""
    block, filled = [], 0
    for text in texts:
        if block and filled + len(text) > size:
            yield block
            block, filled = [], 0
        block.append(text)
        filled += len(text)
    if block:
        yield block


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, spans (kind:start:end, comma-joined), base_spans and the matches of the first `base` rules: one row per document."""

    def make():
        scanner = Scanner(rules)
        text = lambda spans: ",".join(f"{rules[p].kind}:{a}:{b}" for a, p, b in spans)

        def step(rows: dict) -> dict:
            found = [x for block in blocks(rows["text"]) for x in scanner.spans(block)]
            kept = [[s for s in x if s[1] < base] for x in found]
            out = {"doc_id": rows["doc_id"], "spans": [text(x) for x in found], "base_spans": [text(x) for x in kept]}
            out["base_sha256"] = [sha256(x.encode()).hexdigest() for x in out["base_spans"]]
            for place, rule in enumerate(rules[:base]):
                out[f"n_{rule.kind}"] = [sum(s[1] == place for s in x) for x in kept]
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{r.kind} bigint" for r in rules[:base])
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string, base_spans string"
    return per_batch(docs.select("doc_id", text_of(docs).alias("text")), make, schema)
