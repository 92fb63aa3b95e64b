"""Spelling variants of frequent words by a frontier over a relational trie.

Words are counted over all texts. Two tries over the words that count, one of them over the reversed words, are kept as
one edge table (node, label, child or word), where a node is a prefix after which words differ and a label the
characters up to the next such prefix. A frontier of states (word, rest of it, node, edits) is joined with the edges
level by level: without an edit along the own path, with one where a label begins with another character (replaced, or
inserted), and from then on along labels that are equal to the rest. Terminal states with one edit are neighbours. A
state starts where half of its word is read: of two words that are one edit apart, one half is equal, and the reversed
trie serves the other half. So a level branches over the few continuations of a long prefix, and the number of levels is
that of the branchings on a path, not that of the characters.

Nodes are hashes of prefixes; two prefixes of one hash only add states, since every pair is compared at the end.

Defined cases: a null text has no words; a null id counts as an empty one where runs are altered; rows count each,
repeated or not; texts and words of any length are used whole; without words there are no rows; columns other than
`doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import materialize, per_batch, pieces, ship_package

LEAST_LENGTH = 7
LEAST_COUNT = 2
ALTERED = 31  # a run is altered where the crc32 of id and run is a multiple of this
RATIO = 10  # so many times a word's count its form must have
# Runs that are shorter make no word: altering shortens them.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)

# A task hands on its counts when they hold so many words or characters.
HELD_WORDS, HELD_CHARACTERS = 400_000, 32 << 20
PRIME, BASE = (1 << 61) - 1, 1_000_003
END = "."  # stands for the end of a word, which consists of letters


def altered(doc: str, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts: long runs in lower case (A-Z), some of them without one character."""
    start, runs = crc32(f"{doc}:".encode()), RUN.findall(text.encode("utf-8").lower().decode("utf-8"))
    for run, n in Counter(runs).items():
        h = crc32(run.encode("utf-8"), start)
        if h % ALTERED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counted(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least LEAST_LENGTH characters and LEAST_COUNT occurrences."""
    ship_package(docs.sparkSession)
    most_words, most_characters = HELD_WORDS, HELD_CHARACTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held = 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

        for whole in batches:
            for part in pieces(whole):
                for doc, text in zip(part["doc"].to_pylist(), part["text"].to_pylist(), strict=True):
                    for word, n in altered(doc, text):
                        if len(word) >= LEAST_LENGTH:
                            before = counts.get(word, 0)
                            held += 0 if before else len(word)
                            counts[word] = before + n
                    if len(counts) > most_words or held > most_characters:
                        yield batch()
                        counts.clear()
                        held = 0
        yield batch()

    texts = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), docs["text"].alias("text"))
    found = texts.where("text IS NOT NULL").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def prefixes(word: str, side: int) -> list[int]:
    """Hashes of all prefixes of the word, of the empty one to the whole word; `side` tells the two tries apart."""
    out = [side + 1]
    for c in word:
        out.append((out[-1] * BASE + ord(c)) % PRIME)
    return out


def sides(word: str) -> tuple[str, str]:
    return word, word[::-1]


def steps(words: DataFrame) -> DataFrame:
    """id, side, depth, node, next: the prefixes of the second half of each word and the characters after them.

    They begin where a shorter or equal word's half begins; the empty `next` stands for the end of the word.
    """

    def make():
        def paths(word: str) -> list[tuple]:
            first = (len(word) - 1) // 2
            return [
                (side, depth, nodes[depth], read[depth : depth + 1])
                for side, read in enumerate(sides(word))
                for nodes in [prefixes(read, side)]
                for depth in range(first, len(word) + 1)
            ]

        return lambda rows: {"id": rows["id"], "path": [paths(w) for w in rows["word"]]}

    path = "path array<struct<side int, depth int, node bigint, next string>>"
    return per_batch(words.select("id", "word"), make, f"id bigint, {path}").select("id", F.inline("path"))


def forks(words: DataFrame) -> DataFrame:
    """id, side, depths: where a word's path branches, ascending; as many depths as the word has characters at most."""
    path = materialize(steps(words), "steps")
    branching = path.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low <> high")
    kept = path.join(branching.select("node"), "node", "left_semi")
    return kept.groupBy("id", "side").agg(F.sort_array(F.collect_list("depth")).alias("depths"))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored edges (node, label, child, target, onward) and the first frontier (id, node, rest, edits).

    An edge leads to the next node, or with the last characters of a word to that word's id; `onward` holds the first
    characters of the child's own edges, no more than there are letters.
    """

    def make():
        def edges_of(id: int, word: str, side: int, depths: list[int]) -> tuple[list[tuple], list[tuple]]:
            read = sides(word)[side]
            nodes = prefixes(read, side)
            edges = [(nodes[a], read[a:b], nodes[b], None) for a, b in zip(depths, depths[1:], strict=False)]
            edges.append((nodes[depths[-1]], read[depths[-1] :], None, id))
            start = next((d for d in depths if d >= len(word) // 2), None)
            return edges, [] if start is None else [(nodes[start], read[start:])]

        def step(rows: dict) -> dict:
            found = [edges_of(*x) for x in zip(rows["id"], rows["word"], rows["side"], rows["depths"], strict=True)]
            return {"id": rows["id"], "edges": [e for e, _ in found], "states": [s for _, s in found]}

        return step

    edge, state = "struct<node bigint, label string, child bigint, target bigint>", "struct<node bigint, rest string>"
    cut = words.select("id", "word").join(forks(words), "id").select("id", "word", "side", "depths")
    both = materialize(per_batch(cut, make, f"id bigint, edges array<{edge}>, states array<{state}>"), "paths")
    edges = materialize(both.select(F.inline("edges")).distinct(), "edges")
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(initial("label")), "").alias("onward"))
    columns = ["node", "label", "child", "target", "onward"]
    inner = edges.where("child IS NOT NULL").join(onward, "child").select(columns)
    last = edges.where("child IS NULL").withColumn("onward", F.lit(None).cast("string")).select(columns)
    return materialize(inner.unionByName(last), "edges"), both.select("id", F.inline("states")).withColumn("edits", F.lit(0))


def initial(text: str | Column) -> Column:
    """The first character, or END."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", F.lit(END)).otherwise(F.substr(text, F.lit(1), F.lit(1)))


def advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The next level: id, node, rest, edits, and `target` where a state has become a neighbour."""
    label, rest, child = F.col("label"), F.col("rest"), F.col("child")
    inner, fresh = child.isNotNull(), F.col("edits") == 0
    label_tail, rest_tail = F.substr(label, F.lit(2)), F.substr(rest, F.lit(2))
    differs = fresh & (label != "") & (initial(label) != initial(rest))

    def step(holds, read, matched, edits):
        """The state after `read`, what is left of the word, has met `matched`, what is left of the label.

        With one edit the child must have an edge for what comes next.
        """
        left = F.substr(read, F.length(matched) + 1)
        on = F.struct(child.alias("node"), left.alias("rest"), edits.alias("edits"), F.col("target"))
        goes_on = F.startswith(read, matched) & ((edits == 0) | F.contains(F.col("onward"), initial(left)))
        return F.when(holds & F.when(inner, goes_on).otherwise(read == matched), on)

    one = F.lit(1)
    moves = F.array(
        # The own path; it need not be followed to the word itself.
        step(inner | ~fresh, rest, label, F.col("edits")),
        # The later of two characters replaces the earlier one; the other word finds the same pair the other way round.
        step(differs & (rest != "") & (initial(label) > initial(rest)), rest_tail, label_tail, one),
        step(differs, rest, label_tail, one),
    )
    return states.join(edges, "node").select("id", F.inline(F.array_compact(moves)))


def neighbours(words: DataFrame) -> DataFrame:
    """id, other, other_word, other_n: all ordered pairs of words that differ by one edit."""
    edges, states = trie(words)
    found = []
    while True:
        level = materialize(advanced(states, edges), "frontier")
        found.append(level.where("target IS NOT NULL").select("id", F.col("target").alias("other")))
        states = level.where("target IS NULL").drop("target")
        if states.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, found).distinct()
    mine = words.select("id", "word", "n")
    other = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    near = pairs.join(mine, "id").join(other, "other").where(F.levenshtein("word", "other_word", 1) == 1)
    # From a word its equally long and longer neighbours are found; the longer ones have the shorter as neighbours.
    ends = lambda a, b: F.struct(
        F.col(a[0]).alias("id"), F.col(b[0]).alias("other"), F.col(b[1]).alias("other_word"), F.col(b[2]).alias("other_n")
    )
    left, right = ("id", "word", "n"), ("other", "other_word", "other_n")
    return near.select(F.inline(F.array(ends(left, right), ends(right, left)))).distinct()


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms from each word that has one.

    A round doubles the length that is followed. Counts grow by RATIO with every link, so chains are short.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        now = new.drop("next")
        if new.where("next IS NOT NULL").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word."""
    numbered = counted(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n")
    words = materialize(numbered, "words")
    # The largest count first, then the smallest word.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other_word").alias("word")))
    near = neighbours(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "id", "left")
    much = -F.col("best.minus") >= F.col("n") * RATIO
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(much, F.col("best.word")).alias("form"),
        F.when(much, -F.col("best.minus")).alias("form_n"),
    )
    stored = materialize(formed, "forms")
    ends = roots(stored.where("form IS NOT NULL"))
    return stored.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
