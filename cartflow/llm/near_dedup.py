"""Near duplicates by Order MinHash.

A sketch samples the occurrence-labelled runs of five words with the lowest hashes and keeps them in text order, so
that two texts agree on it when they share runs in the same order. The lowest run of each sketch is a key as well, which
serves pairs with scattered edits. Texts that agree on a key are candidates; a link needs an alignment of their words
with 1 - edits / longer length of at least 0.8. Classes are the connected components.

Candidates are texts of one bucket, of which one text is the centre: the one that shares most keys with others, since an
original shares more of them with its copies than these do with each other. Each text is first compared with the centres of
its buckets, which are few. The texts of buckets that hold several classes after that are joined exactly: those of small
buckets by pairs, those of others by their leading runs of three words (`leading`), of which two texts within the similarity
share a number that grows with their length, whatever else a common passage makes them share.
So every pair of a bucket is linked, or in one class already, or shown to be no link. Pairs that share no key at all are no
candidates; how many links that costs is measured in the tests and told in the README.

Defined cases: a null text counts as empty, all texts without words are copies of each other; texts below five words
have one run; texts of any length are used whole; repeated rows and exact copies share a class; `class_id` is the
smallest id of the class, and null ids count only where a class has no other; an empty table gives no rows; columns
other than `doc_id` and `text` are not looked at and those of `keep_first` are kept.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.alignment import within
from cartflow.llm.common import discard, in_sample, materialize, per_batch, text_of
from cartflow.llm.components import components, forest

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
# Texts that tell which grams are common, and the occurrences among them from which on one is.
COMMON_TEXTS, COMMON = 10_000, 4
# The sample is this part of the texts at least: a passage that it does not show has the same number of texts whatever the table's
# size. Of the common grams it keeps as many as fit the driver, the most frequent ones.
COMMON_PART, COMMON_GRAMS = 0.125, 1 << 20
# Texts of a bucket up to which all its pairs are formed: half as many pairs for each text of a bucket.
SMALL = 32

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def runs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; of all words together if there are fewer."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            out = mixed((out + words[k : k + n]) * ODD)
    return out


def labelled_runs(runs: np.ndarray) -> np.ndarray:
    """Runs hashed with the number of their occurrence, so that repeats are different elements."""
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if first.size == len(runs):
        return runs
    nth = np.arange(len(runs)) - np.repeat(first, np.diff(np.concatenate((first, [len(runs)]))))
    out = np.empty_like(runs)
    with np.errstate(over="ignore"):
        out[order] = np.where(nth == 0, ordered, mixed(ordered + nth.astype(np.uint64) * ODD))
    return out


def sketches(words: np.ndarray, seeds: np.ndarray) -> list[int]:
    """Two signed 64-bit keys per seed: first all ordered samples of two runs, then the lowest run of each."""
    runs = runs_of(words)
    elements, lines = labelled_runs(runs), np.arange(len(seeds))
    with np.errstate(over="ignore"):
        ranks = mixed((elements[None] ^ seeds[:, None]) * ODD)
        least = second = ranks.argmin(1)
        if len(runs) > 1:
            ranks[lines, least] = np.iinfo(np.uint64).max
            second = ranks.argmin(1)
        ordered = mixed((seeds + runs[np.minimum(least, second)]) * ODD)
        ordered = mixed((ordered + runs[np.maximum(least, second)]) * ODD)
        single = mixed((~seeds + runs[least]) * ODD)
    return np.concatenate((ordered, single)).view(np.int64).tolist()


def signatures(texts: DataFrame, count: int) -> DataFrame:
    """doc_id, node (digest of the text), the keys of its sketches, its number of words and the words. No shuffle.

    The words are hashes of 16 bits each: two different words look equal once in 65,536 times.
    """

    def make():
        seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * ODD)

        def step(rows: dict) -> dict:
            words = [words_of(text) for text in rows["text"]]
            hashed = [np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in words]
            return {
                "doc_id": rows["doc_id"],
                "node": rows["node"],
                "keys": [sketches(h, seeds) if h.size else [] for h in hashed],
                "length": list(map(len, hashed)),
                "words": [h.astype(np.uint16).tobytes() for h in hashed],
            }

        return step

    kind = texts.schema["doc_id"].dataType.simpleString()
    return per_batch(texts, make, f"doc_id {kind}, node binary, keys array<bigint>, length int, words binary")


def bucket_keys(keys: str = "keys") -> Column:
    return F.transform(keys, lambda x, i: F.xxhash64(x, i))


def memberships(nodes: DataFrame) -> DataFrame:
    """key, node, length, popular: the buckets of more than one text. A text is as popular as its buckets are large."""
    rows = nodes.select("node", "length", F.explode(bucket_keys()).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "key"), "shared")
    popular = shared.groupBy("node").agg(F.sum("n").alias("popular"))
    members = materialize(shared.drop("n").join(popular, "node"), "members")
    discard(nodes.sparkSession, shared)
    return members


def with_centres(members: DataFrame) -> DataFrame:
    """The members with `centre` and `centre_length`, those of the most popular text of their bucket."""
    best = F.max(F.struct("popular", "node", "length")).alias("best")
    chosen = members.groupBy("key").agg(best).select("key", F.col("best.node").alias("centre"), F.col("best.length").alias("centre_length"))
    return members.join(chosen, "key")


def candidates(members: DataFrame, similarity: float) -> DataFrame:
    """node, centre, agreed: pairs of a text with the centres of its buckets, of lengths that allow a link."""
    short, long = (f("length", "centre_length") for f in (F.least, F.greatest))
    met = members.where((F.col("node") != F.col("centre")) & (short >= long * similarity - 1e-6))
    return met.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("agreed"))


def verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, centre) whose alignment reaches the similarity, as edges u, v."""
    mine = words.select("node", F.col("words").alias("a"))
    other = words.select(F.col("node").alias("centre"), F.col("words").alias("b"))
    both = pairs.select("node", "centre").join(mine, "node").join(other, "centre")

    def make():
        def step(rows: dict) -> dict:
            read = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) for a, b in zip(rows["a"], rows["b"], strict=True)]
            kept = np.flatnonzero(within(read, similarity))
            return {"u": [rows["node"][i] for i in kept], "v": [rows["centre"][i] for i in kept]}

        return step

    return per_batch(both.select("node", "centre", "a", "b"), make, "u binary, v binary")


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes after more links: only those between two of them are looked at, between their roots."""
    end = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    moved = edges.join(end("u"), "u", "left").join(end("v"), "v", "left")
    between = moved.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v")
    between = materialize(between.distinct(), "links")
    if between.isEmpty():
        return roots
    joined = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = roots.join(joined, roots["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    single = joined.join(roots.select(F.col("node").alias("old")), "old", "left_anti")
    return materialize(known.unionByName(single.select(F.col("old").alias("node"), F.col("new").alias("root"))), "classes")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the rows with `node` and `centre` whose two are not in one class."""
    mine = roots.select("node", F.col("root").alias("my_root"))
    other = roots.select(F.col("node").alias("centre"), F.col("root").alias("other_root"))
    pairs = pairs.join(mine, "node", "left").join(other, "centre", "left")
    return pairs.where(F.coalesce("my_root", "node") != F.coalesce("other_root", "centre")).drop("my_root", "other_root")


def gram_size(similarity: float) -> int:
    """Words of a gram. An edit changes that many grams, so this times the share of edits has to stay well below 1."""
    return 3 if similarity >= 0.8 else 2 if similarity >= 0.7 else 1


def grams_of(words: np.ndarray, size: int) -> list[int]:
    """All runs of `size` words as different elements, with blanks before and behind the text."""
    blank = np.zeros(size - 1, np.uint64)
    padded = np.concatenate((blank, words.astype(np.uint64) + np.uint64(1), blank))
    n = len(padded) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mixed((out + padded[k : k + n]) * ODD)
    return labelled_runs(out).view(np.int64)


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, length, root, small: the texts of buckets that hold several classes, and whether the bucket is a small one."""
    placed = members.select("key", "node", "length").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    return placed.join(several.select("key", (F.col("n") <= SMALL).alias("small")), "key")


def in_reach(low: str, high: str, other_low: str, other_high: str, similarity: float) -> Column:
    """True where texts of two ranges of lengths can be links."""
    return (F.col(other_high) >= F.col(low) * similarity - 1e-6) & (F.col(high) >= F.col(other_low) * similarity - 1e-6)


def direct_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """node, centre: all pairs of small buckets from different classes, of lengths that allow a link."""
    mine = placed.where("small").drop("small")
    other = mine.select("key", *[F.col(n).alias(f"other_{n}") for n in ("node", "length", "root")])
    met = mine.join(other, "key").where((F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")))
    met = met.where(in_reach("length", "length", "other_length", "other_length", similarity))
    return met.select("node", F.col("other_node").alias("centre")).distinct()


def common_grams(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that recur in a sample of the texts, ascending, and how often: they only order the grams of a text."""

    def make():
        def step(rows: dict) -> dict:
            return {"grams": [grams_of(np.frombuffer(w, np.uint16), size).tolist() for w in rows["words"]]}

        return step

    count = texts.count()
    sample = texts.where(in_sample(F.col("node"), count, max(COMMON_TEXTS, int(count * COMMON_PART)))).select("words")
    rows = per_batch(sample, make, "grams array<bigint>").select(F.explode("grams").alias("gram"))
    found = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    table = found.orderBy(F.desc("n"), "gram").limit(COMMON_GRAMS).toArrow()
    grams, often = (table[name].to_numpy() for name in ("gram", "n"))
    order = np.argsort(grams)
    return grams[order], often[order]


def surplus(similarity: float) -> float:
    """The leading grams that two texts share, above one, as a part of the words of the shorter: an eighth of what is left at least."""
    return max(0.0, 1 - gram_size(similarity) * (1 - similarity)) / 8


def needed(low: str, high: str, similarity: float) -> Column:
    """How many leading grams two texts of these lengths share at least if they are a link."""
    return 1 + F.floor(F.least(low, high) * surplus(similarity) + 1e-6)


def leading(texts: DataFrame, similarity: float) -> DataFrame:
    """number, class, length, gram: of every text its rarest grams, as many as a partner can lack and `needed` more.

    Each of d edits takes `size` grams away, so a text of n words lacks at most `size` * (1 - similarity) * n grams of a
    partner. In any order of all grams, the first k that two texts share are then among the first ones of both, as many as
    each can lack and k more. Grams known to be common come last in that order. Leading grams of one class only go.
    """
    size, part = gram_size(similarity), surplus(similarity)
    known, often = common_grams(texts, size)

    def make():
        def lead(words: np.ndarray) -> np.ndarray:
            grams = grams_of(words, size)
            level = np.zeros(len(grams), np.int64)
            if known.size:
                at = np.minimum(np.searchsorted(known, grams), known.size - 1)
                level = np.where(known[at] == grams, often[at], 0)
            lacks = int(np.floor(size * (1 - similarity) * len(words) + 1e-6))
            return grams[np.lexsort((grams, level))[: lacks + 1 + int(np.floor(part * len(words) + 1e-6))]]

        def step(rows: dict) -> dict:
            words = [np.frombuffer(w, np.uint16) for w in rows["words"]]
            return {"number": rows["number"], "class": rows["class"], "length": list(map(len, words)), "grams": list(map(lead, words))}

        return step

    numbers = texts.groupBy("root").agg(F.min("number").alias("class"))
    placed = texts.select("number", "root", "words").join(numbers, "root")
    led = per_batch(placed.select("number", "class", "words"), make, "number bigint, class bigint, length int, grams array<bigint>")
    met = Window.partitionBy("gram")
    led = led.select("number", "class", "length", F.explode("grams").alias("gram"))
    led = led.withColumns({"low": F.min("class").over(met), "high": F.max("class").over(met)})
    return materialize(led.where("low <> high").drop("low", "high"), "leading")


def rest(members: DataFrame, roots: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """node, centre: of the texts of unsettled buckets all pairs from different classes that can be links."""
    spark = members.sparkSession
    placed = materialize(unsettled(members, roots), "placed")
    texts = placed.where("not small").select("node", "root").distinct().join(words, "node")
    texts = materialize(texts.withColumn("number", F.monotonically_increasing_id()), "unsettled")
    pairs = materialize(sharing(texts, similarity).unionByName(direct_pairs(placed, similarity)).distinct(), "rest")
    discard(spark, texts, placed)
    return pairs


def sharing(texts: DataFrame, similarity: float) -> DataFrame:
    """node, centre: the pairs from different classes that share as many leading grams as a link does.

    Classes meet before their texts do, so that a large class that shares a gram with few others is not joined with itself.
    Those whose lengths rule out a link do not meet. Texts and classes go by numbers, which are narrower than digests.
    """
    spark = texts.sparkSession
    leads = leading(texts, similarity)
    discard(spark)
    held = leads.groupBy("gram", "class").agg(
        F.min("length").alias("short"), F.max("length").alias("long"), F.min("number").alias("first"), F.max("number").alias("last")
    )
    other = held.select("gram", *[F.col(n).alias(f"other_{n}") for n in held.columns[1:]])
    met = held.join(other, "gram").where(F.col("class") < F.col("other_class"))
    met = met.where(in_reach("short", "long", "other_short", "other_long", similarity)).drop("long", "other_long")
    met = materialize(met, "met")
    discard(spark)
    alone = (F.col("first") == F.col("last")) & (F.col("other_first") == F.col("other_last"))
    enough = needed("short", "other_short", similarity).alias("enough")
    direct = met.where(alone).select(F.col("first").alias("number"), F.col("other_first").alias("other_number"), enough)
    other = leads.select("gram", *[F.col(n).alias(f"other_{n}") for n in ("number", "class", "length")])
    wider = met.where(~alone).select("gram", "class", "other_class").join(leads, ["gram", "class"]).join(other, ["gram", "other_class"])
    wider = wider.where(in_reach("length", "length", "other_length", "other_length", similarity))
    wider = wider.select("number", "other_number", needed("length", "other_length", similarity).alias("enough"))
    shared = direct.unionByName(wider).groupBy("number", "other_number", "enough").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared.where("n >= enough").select("number", "other_number")
    named = texts.select("number", "node")
    pairs = pairs.join(named, "number").join(named.select(F.col("number").alias("other_number"), F.col("node").alias("centre")), "other_number")
    found = materialize(pairs.select("node", "centre"), "sharing")
    discard(spark, leads, met)
    return found


def needed_words(signed: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, words: one copy of each text that shares a bucket."""
    ids = nodes.select(F.col("node").alias("wanted"), F.col("doc_id").alias("wanted_id"))
    needed = members.select(F.col("node").alias("wanted")).distinct().join(ids, "wanted")
    same = (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    rows = signed.select("doc_id", "node", "words").join(needed, same)
    return rows.dropDuplicates(["node"]).select("node", "words")


def classes(docs: DataFrame, similarity: float = SIMILARITY, count: int = SKETCHES) -> DataFrame:
    """doc_id, node, class_id, class_node, class_size: one row per document."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"], text_of(docs).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    signed = materialize(signatures(texts, count), "sketches")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("length").alias("length"))
    members = memberships(nodes.select("node", "keys", "length").where(F.size("keys") > 0))
    words = materialize(needed_words(signed, nodes, members), "words")
    found = materialize(candidates(with_centres(members), similarity), "candidates")
    # The centre that a text meets most often links most texts; the others are for those it leaves apart.
    # A centre is more popular than the text, so these links have no cycle.
    most = found.groupBy("node").agg(F.max_by("centre", F.struct("agreed", "centre")).alias("centre"))
    links = materialize(verified(most, words, similarity), "links")
    roots = forest(links)
    discard(spark, links)
    others = found.join(most.withColumn("done", F.lit(True)), ["node", "centre"], "left").where("done is null")
    roots = merged(roots, verified(apart(others, roots), words, similarity))
    discard(spark, found)
    pairs = rest(members, roots, words, similarity)
    discard(spark, members)
    roots = merged(roots, verified(pairs, words, similarity))
    discard(spark, pairs, words)

    placed = signed.select("doc_id", "node").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    named = placed.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    named = named.select("root", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("class_node"), "class_size")
    return placed.join(named, "root").select("doc_id", "node", "class_id", "class_node", "class_size")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the smallest id, with all columns of `docs`."""
    placed = classes(docs, similarity)
    kept = placed.select(F.col("class_node").alias("__node"), F.col("class_id").alias("__id")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row"),
        docs["doc_id"].alias("__own"),
        F.unhex(F.md5(text_of(docs))).alias("__node"),
    )
    joined = rows.join(kept, "__node").where(F.col("__own").eqNullSafe(F.col("__id")))
    return joined.dropDuplicates(["__node"]).select("__row.*")
