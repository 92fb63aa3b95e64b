"""Benchmark decontamination by templates.

Texts become templates: numbers, units and names are replaced by typed placeholders, other words are lower-cased;
characters of scripts without spaces are words of their own. A capitalised word that starts a sentence may be a name or
not, so windows that hold one are taken both ways. Windows of template words are hash-joined between documents and
benchmark items. On one diagonal a window counts if it is equal to the item's, or if its changed slots are filled as most
windows there fill them: each number and unit by one value, each name by one name that stands for no other. So a question
with other numbers or names is found, and a chance meeting of templates is not. A document is contaminated by an item if
windows that count cover at least SHARE of the item's windows, or a run of RUN words.

Items without a window of LITERALS plain words, such as formulas and questions of a few words, are looked for as they are
written, without placeholders: all their windows of literal words must be there. One or two such words must be the whole
document. Windows that more than COMMON items hold lead to an item only where it would otherwise not have enough windows
of its own, and count for no run.

Defined cases: a null text counts as empty and matches nothing; texts of any length are read whole; items without a
visible character are not looked for, shorter ones than a window are looked for as a whole; items with the same template
count as one, named by the smallest id; repeated documents each give their rows; a null id stays null; empty tables give
no rows; columns other than `doc_id`, `item_id` and `text` are not looked at, and those of `clean_documents` are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.common import Memo, materialize, per_batch, text_of

WINDOW = 8
LITERALS = 4  # plain words that a window needs
SHARE = 0.5
RUN = 13  # template words of an item in a row
COMMON = 50  # items that hold a window, beyond which it tells little
SHORT = 3  # literal words, below which an item must be a whole document
BLOCK = 1 << 20  # characters of the texts that become templates together
FILTER_BITS = 24  # of the Bloom filter over the benchmark's windows; its size does not depend on the benchmark

LITERAL, NUMBER, UNIT, CAPITAL, NOTHING = range(5)
# Words that count as numbers and as units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds "
    "ounce ounces oz ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day "
    "days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters "
    "metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts hz"
).split()
NUMERIC = re.compile(r"[+-]?\d[\d.,:/]*(?:%|[^\W\d_]{1,3})?")
EDGES = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#-/"  # of what EDGES removes, the characters that most words have at their edges
# Scripts without spaces: Thai to Khmer, kana, Han and their extensions.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_TEXT, WORD = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")


def words_of(text: str) -> list[str]:
    return text.split() if text.isascii() or not UNSPACED_TEXT.search(text) else WORD.findall(text)


def literal_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the words as they are written, but for case and the punctuation around them."""
    return np.array([xxhash.xxh64_intdigest("literal " + (EDGES.sub("", w) or w).lower()) for w in words], np.uint64)


class Template(NamedTuple):
    """Per template word its hash, the kind of its placeholder or 0, where it starts and ends in the written words, its
    place in its text, whether it is a name only here, and the number of its text."""

    hashes: np.ndarray
    holder: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    place: np.ndarray
    only: np.ndarray
    text: np.ndarray


class Codes(dict):
    """Codes of written words; `code` gives and remembers that of a new one."""

    def __init__(self, code: Callable[[str], int]):
        super().__init__()
        self.code = code

    def __missing__(self, written: str) -> int:
        return self.code(written)


class Canon:
    """Template words by a table of distinct written words; the table starts anew beyond `limit` words."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.kinds = {w: NUMBER for w in NUMBER_WORDS} | {w: UNIT for w in UNIT_WORDS}
        self.holders = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in ("", "number", "unit", "name")], np.uint64)
        self.clear()

    def clear(self) -> None:
        self.codes = Codes(self.code)
        self.kind = np.zeros(1024, np.int8)
        self.ends = np.zeros(1024, bool)
        self.hash = np.zeros(1024, np.uint64)

    def code(self, written: str) -> int:
        at = self.codes[written] = len(self.codes)
        if at >= len(self.kind):
            self.kind, self.ends, self.hash = (np.concatenate((x, np.zeros_like(x))) for x in (self.kind, self.ends, self.hash))
        # Letters alone are no number; without punctuation around them they end no sentence.
        word = written.strip(PUNCTUATION)
        letters = word.isalpha()
        word = word if letters else EDGES.sub("", written)
        lower = word.lower()
        kind = self.kinds.get(lower, CAPITAL if word[:1].isupper() else LITERAL)
        if letters:
            pass
        elif not word:
            kind = NOTHING
        elif NUMERIC.fullmatch(word.strip("$€£")):
            kind = NUMBER
        elif lower in "%$€£":
            kind = UNIT
        self.kind[at] = kind
        if len(word) < len(written):
            self.ends[at] = written.rstrip("\"')]")[-1:] in (".", "!", "?")
        self.hash[at] = self.holders[kind] if kind in (NUMBER, UNIT) else xxhash.xxh64_intdigest(lower)
        return at

    def templates(self, words: list[str], sizes: list[int] | None = None) -> list[Template]:
        """The templates of the texts of so many words each, one after the other; of one text if there are no sizes.

        A capitalised word is a name; one that starts a sentence is plain in the first template and a name in the
        second. Names in a row are one. Places count the words of the first template in both.
        """
        if len(self.codes) > self.limit:
            self.clear()
        stops = np.cumsum(sizes or [len(words)])
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(self.kind[codes] != NOTHING)
        codes, text = codes[at], np.searchsorted(stops, at, "right")
        kind = self.kind[codes]
        goes_on = np.concatenate(([False], ~self.ends[codes][:-1] & (text[1:] == text[:-1])))[: len(codes)]
        out, place = [], None
        for name in (first := (kind == CAPITAL) & goes_on, kind == CAPITAL):
            kept = np.ones(len(codes), bool)
            kept[1:] = ~(name[1:] & name[:-1] & goes_on[1:])
            if place is None:
                place = np.cumsum(kept)
                place -= place[np.searchsorted(text, text)]
            hashes = np.where(name, self.holders[3], self.hash[codes])
            holder = np.where(name, CAPITAL, np.where((kind == NUMBER) | (kind == UNIT), kind, 0))
            start, owner = at[kept], text[kept]
            stop = np.minimum(np.append(start[1:], stops[-1:]), stops[owner])
            out.append(Template(hashes[kept], holder[kept], start, stop, place[kept], (name & ~first)[kept], owner))
        return out if out[1].only.any() else out[:1]


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words."""
    n = len(hashes) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            out += hashes[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def window_hashes(hashes: np.ndarray, holder: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of `size` template words with enough plain words."""
    found = runs_of(hashes, size)
    plain = np.concatenate(([0], np.cumsum(holder == 0)))
    start = np.flatnonzero(plain[size:] - plain[:-size] >= LITERALS) if found.size else np.zeros(0, np.int64)
    return start, found[start]


def windows_both_ways(templates: list[Template], size: int) -> Iterator[tuple[Template, np.ndarray, np.ndarray]]:
    """Per template the starts and hashes of its windows, each in one text; of the second those with a name only there."""
    for number, template in enumerate(templates):
        start, found = window_hashes(template.hashes, template.holder, size)
        own = template.text[start] == template.text[start + size - 1]
        if number:
            seen = np.concatenate(([0], np.cumsum(template.only)))
            own &= seen[start + size] > seen[start]
        yield template, start[own], found[own]


Slot = tuple[int, str]  # kind and written value


def slots(words: list[str], template: Template, start: int, size: int) -> list[Slot]:
    """The placeholders of a window, in order."""
    held = start + np.flatnonzero(template.holder[start : start + size])
    spans = zip(template.holder[held].tolist(), template.start[held].tolist(), template.stop[held].tolist(), strict=True)
    return [(kind, " ".join(EDGES.sub("", w) for w in words[a:b]).strip()) for kind, a, b in spans]


def window(words: list[str], template: Template, start: int, found: int, size: int) -> dict:
    return {"hash": found, "at": int(template.place[start]), "size": size, "slots": slots(words, template, start, size)}


def literal_windows(words: list[str], size: int) -> list[dict]:
    found = runs_of(literal_hashes(words), size).tolist()
    return [{"hash": h, "at": i, "size": -size, "slots": []} for i, h in enumerate(found)]


# The size of a window of literal words is negative.
WINDOWS = "array<struct<hash:bigint,at:int,size:int,slots:array<struct<kind:int,value:string>>>>"


def item_windows(benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """item_id, n_windows (places with a window), and per window of one item of each template what it is and whether it
    leads to its item."""

    def make():
        canon = Canon()

        def step(rows: dict) -> dict:
            out = {"item_id": rows["item_id"], "template": [], "windows": []}
            for text in rows["text"]:
                words = words_of(text)
                templates = canon.templates(words)
                hashes = templates[0].hashes
                values = slots(words, templates[0], 0, len(hashes))
                first = {v: i for i, v in reversed(list(enumerate(values)))}
                pattern = hashes.tobytes() + repr([first[v] for v in values]).encode()
                windows = []
                for size in sorted({max(1, min(WINDOW, len(t.hashes))) for t in templates}):
                    for template, start, found in windows_both_ways(templates, size):
                        if size == max(1, min(WINDOW, len(template.hashes))):
                            windows += [window(words, template, s, h, size) for s, h in zip(start.tolist(), found.tolist(), strict=True)]
                if words and not windows:
                    windows = literal_windows(words, min(WINDOW, len(words)))
                    pattern = literal_hashes(words).tobytes()
                out["template"].append(xxhash.xxh128_hexdigest(pattern))
                out["windows"].append(windows)
            return out

        return step

    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, template string, windows {WINDOWS}"
    items = per_batch(benchmark.select("item_id", text_of(benchmark).alias("text")), make, schema)
    one = items.groupBy("template").agg(F.min(F.struct("item_id", "windows")).alias("first")).select("first.*")
    places = F.size(F.array_distinct(F.transform("windows", lambda w: w["at"])))
    flat = one.select("item_id", places.alias("n_windows"), F.explode("windows").alias("w"))
    flat = flat.select("item_id", "n_windows", "w.hash", "w.size", F.col("w.at").alias("item_at"), F.col("w.slots").alias("item_slots"))
    held = flat.groupBy("hash").agg(F.countDistinct("item_id").alias("held"))
    # The rarest windows of an item, so many that one of them is among any SHARE of all.
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("held", "item_at", "hash"))
    enough = F.floor(F.col("n_windows") * (1 - share)) + 1
    ranked = flat.join(held, "hash").withColumn("rank", rarest)
    common = F.col("held") > COMMON
    return ranked.select(*flat.columns, (~common | (F.col("rank") <= enough)).alias("leads"), common.alias("common"))


def bloom(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set over the hashes, put together by Spark; at most 2^bits / 64 words come to the driver."""
    slot = F.col("hash").bitwiseAND((1 << bits) - 1)
    words = windows.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row.word] = row.bits
    return out


def together(texts: list[str], characters: int = BLOCK) -> Iterator[list[str]]:
    """The texts in blocks that end with the text that reaches the number of characters."""
    first = size = 0
    for n, text in enumerate(texts, 1):
        size += len(text)
        if size >= characters or n == len(texts):
            yield texts[first:n]
            first, size = n, 0


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, node and those windows that the filter lets pass. No shuffle."""
    width = int(len(bits)).bit_length() + 5
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    plain, literal = [n for n in sizes if n > 0], [-n for n in sizes if n < 0]

    def make():
        canon, known = Canon(), np.frombuffer(sent.value, np.int64)
        memo = Memo(lambda word: int(literal_hashes([word])[0]))

        def known_words(words: list[str]) -> np.ndarray:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

        def passing(found: np.ndarray) -> np.ndarray:
            slot = found & ((1 << width) - 1)
            return np.flatnonzero(known[slot >> 6] >> (found & 63) & 1)

        def literal_windows_of(words: list[str]) -> list[dict]:
            # One or two words count as the whole document only.
            looked = [size for size in literal if len(words) >= size and (size >= SHORT or len(words) == size)]
            out, hashes = [], known_words(words) if looked else None
            for size in looked:
                found = runs_of(hashes, size)
                out += [{"hash": int(found[i]), "at": i, "size": -size, "slots": []} for i in passing(found).tolist()]
            return out

        def windows_of(texts: list[str]) -> list[list[dict]]:
            split = [words_of(text) for text in texts]
            out, words = [literal_windows_of(w) for w in split], list(chain.from_iterable(split))
            templates = canon.templates(words, list(map(len, split)))
            for size in plain:
                for template, start, found in windows_both_ways(templates, size):
                    for i in passing(found).tolist():
                        at = int(start[i])
                        out[template.text[at]].append(window(words, template, at, int(found[i]), size))
            return out

        def step(rows: dict) -> dict:
            return {"doc_id": rows["doc_id"], "node": rows["node"], "windows": [w for texts in together(rows["text"]) for w in windows_of(texts)]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn("node", F.xxhash64("text"))
    schema = f"doc_id {kind}, node bigint, windows {WINDOWS}"
    passed = per_batch(texts, make, schema).select("doc_id", "node", F.explode("windows").alias("w"))
    return passed.select("doc_id", "node", "w.hash", "w.at", "w.slots")


def counting(windows: list[dict]) -> list[dict]:
    """Those windows of a diagonal that are equal to the item's, or whose changed slots are filled as most are there."""
    votes: dict[tuple, Counter] = {}
    for w in windows:
        for i, d in zip(w["item"], w["doc"], strict=True):
            votes.setdefault((i["kind"], i["value"]), Counter())[d["value"]] += 1
            if i["kind"] == CAPITAL:
                votes.setdefault(("from", d["value"]), Counter())[i["value"]] += 1
    # Ties go to the smallest value.
    chosen = {k: min(c, key=lambda v: (-c[v], v)) for k, c in votes.items()}

    def fits(i: dict, d: dict) -> bool:
        if i["value"] == d["value"]:
            return True
        same = chosen[i["kind"], i["value"]] == d["value"]
        return same and (i["kind"] != CAPITAL or chosen["from", d["value"]] == i["value"])

    return [w for w in windows if all(fits(i, d) for i, d in zip(w["item"], w["doc"], strict=True))]


def covered(windows: list[dict]) -> tuple[int, int]:
    """Places that the windows cover, and the longest run of template words under those that are not common."""
    longest = start = end = 0
    for at, size in sorted({(w["at"], w["size"]) for w in windows if w["size"] > 0 and not w["common"]}):
        start, end = (start, max(end, at + size)) if at <= end else (at, at + size)
        longest = max(longest, end - start)
    return len({w["at"] for w in windows}), longest


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, node, item_id, covered: the contaminated documents with the items found in them.

    `covered` is the share of the item's windows on its best diagonals.
    """
    items = materialize(item_windows(benchmark, share), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most 2 x WINDOW values
    found = materialize(document_windows(docs, bloom(items), sizes), "windows")
    keys = ["doc_id", "node", "item_id"]
    led = found.select("doc_id", "node", "hash").join(items.where("leads").select("hash", "item_id"), "hash").select(keys).distinct()
    same = F.col("l.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("l.node") == F.col("f.node"))
    near = led.alias("l").join(found.alias("f"), same).select("l.doc_id", "l.node", F.col("l.item_id").alias("led"), "f.hash", "f.at", "f.slots")
    sides = F.struct(F.col("item_at").alias("at"), "size", "common", F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    met = near.join(items, (near["hash"] == items["hash"]) & F.col("led").eqNullSafe(F.col("item_id")))
    # A diagonal has at most the windows of an item, each in a few readings.
    lines = met.groupBy(*keys, "n_windows", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set(sides).alias("windows"))

    def make():
        def step(rows: dict) -> dict:
            kept = [counting(w) for w in rows["windows"]]
            sums = [covered(w) for w in kept]
            out = {k: rows[k] for k in (*keys, "n_windows")}
            return out | {"places": [sorted({x["at"] for x in w}) for w in kept], "run": [n for _, n in sums], "literal": [any(x["size"] < 0 for x in w) for w in kept]}

        return step

    kinds = {n: t.dataType.simpleString() for n, t in zip(lines.schema.names, lines.schema, strict=True)}
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "n_windows")) + ", places array<int>, run int, literal boolean"
    counted = per_batch(lines.select(*keys, "n_windows", "windows"), make, schema)
    whole = counted.groupBy(*keys, "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"),
        F.max("run").alias("run"),
        F.max(F.when(F.col("literal"), F.size("places")).otherwise(0)).alias("verbatim"),
        F.max("literal").alias("literal"),
    )
    part = F.col("n") / F.col("n_windows")
    caught = F.when(F.col("literal"), F.col("verbatim") == F.col("n_windows")).otherwise((part >= share) | (F.col("run") >= RUN))
    return whole.where(caught).select(*keys, part.alias("covered"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents without a match, with all their columns."""
    bad = materialize(matches(docs, benchmark, share).select(F.col("node").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(text_of(docs)) == F.col("__bad"), "left_anti")
