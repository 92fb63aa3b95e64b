"""Near duplicates, repeated passages and benchmark leaks against brute force, with planted cases."""

import random

import numpy as np
import pytest

from cartflow.llm import alignment, components, decontam, near_dedup, queries, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_banded_alignment_equals_the_full_table():
    random_ = np.random.default_rng(0)
    pairs = []
    for _ in range(500):
        a = random_.integers(0, random_.choice([3, 50]), random_.integers(0, 60)).astype(np.uint16)
        b = list(a)
        for _ in range(random_.integers(0, 14)):
            at = int(random_.integers(0, len(b) + 1))
            kind = random_.integers(0, 3)
            if kind == 0:
                b.insert(at, 7)
            elif b:
                at = min(at, len(b) - 1)
                b[at : at + 1] = [] if kind == 1 else [9]
        pairs.append((a, np.array(b, np.uint16)))
    expected = [1 - edits(a.tolist(), b.tolist()) / max(1, len(a), len(b)) >= 0.8 - 1e-12 for a, b in pairs]
    assert alignment.within(pairs, 0.8).tolist() == expected


def edited(random, words, count, vocabulary):
    out = list(words)
    for kind, at in zip(random.integers(0, 3, count), random.random(count), strict=True):
        at = int(at * (len(out) + (kind == 0)))
        out[at : at + (kind > 0)] = [int(random.integers(vocabulary))] if kind < 2 else []
    return np.array(out, np.uint16)


@pytest.mark.parametrize("vocabulary", [2, 5, 40, 60_000])
def test_bounds_of_the_distance(vocabulary):
    random = np.random.default_rng(vocabulary)
    for n in range(200):
        a = random.integers(0, vocabulary, random.integers(4, 40)).astype(np.uint16)
        b = edited(random, a, int(random.integers(0, 4)), vocabulary)
        b = random.permutation(b) if n % 9 == 0 else b
        distance = edits(a.tolist(), b.tolist())
        assert alignment.replaced(a, b) >= distance and alignment.aligned_edits(a, b) >= distance
        # Words beyond 16 bits are not taken for others.
        assert alignment.aligned_edits(a.astype(np.int64), b.astype(np.int64) + (1 << 48)) == max(len(a), len(b))


def test_edited_copies_need_no_band(monkeypatch):
    random = np.random.default_rng(3)
    words = random.integers(0, 60_000, (50, 300)).astype(np.uint16)
    pairs = [(w, edited(random, w, 30, 60_000)) for w in words]
    monkeypatch.setattr(alignment, "band_distances", None)
    assert alignment.within(pairs, 0.8).all()


def test_a_larger_table_has_a_larger_sample(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON_TEXTS", 10)
    random = np.random.default_rng(4)
    passage = random.integers(0, 60_000, 20)
    texts = [np.concatenate((random.integers(0, 60_000, 30), passage if n % 4 == 0 else [])).astype(np.uint16) for n in range(800)]
    frame = spark.createDataFrame([(bytearray(str(n).encode()), bytearray(w.tobytes())) for n, w in enumerate(texts)], "node binary, words binary")
    known, often = near_dedup.common_grams(frame, 3)
    assert set(near_dedup.grams_of(passage.astype(np.uint16), 3)[2:-2].tolist()) <= set(known.tolist())
    assert (np.diff(known) > 0).all() and often.min() >= near_dedup.COMMON


def test_pairs_that_end_or_are_above_the_width_leave_the_band(monkeypatch):
    """A long pair among short ones does not make these as long: the cells met stay near the sum of the lengths."""
    random_ = np.random.default_rng(1)
    pairs = []
    for n in [3000] + [30] * 300:
        a = random_.integers(0, 60000, n).astype(np.uint16)
        b = a.copy()
        b[:: n // 4] += 1
        pairs.append((a, b))
    met, least = [], np.minimum

    class Counting:
        accumulate = staticmethod(lambda x, *args, **kwargs: met.append(len(x)) or least.accumulate(x, *args, **kwargs))

        def __call__(self, *args, **kwargs):
            return least(*args, **kwargs)

    monkeypatch.setattr(alignment.np, "minimum", Counting())
    found = alignment.band_distances(pairs, 8)
    monkeypatch.undo()
    assert found.tolist() == [edits(a[:30].tolist(), b[:30].tolist()) if len(a) == 30 else int((a != b).sum()) for a, b in pairs]
    assert sum(met) < 2 * sum(len(a) for a, _ in pairs)


def test_tables_between_the_steps_are_deleted(spark):
    """Of all that near_dedup stores only the sketches and the classes stay, which the result reads."""
    from pathlib import Path

    from cartflow.session import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = {p.name for p in root.glob("*")} if root.exists() else set()
    rng = random.Random(31)
    near_dedup.classes(frame(spark, chains(rng, [f"w{i}" for i in range(5000)], 5))).collect()
    left = {p.name.rsplit("-", 1)[0] for p in root.glob("*") if p.name not in before}
    assert left & {"sketches"} and not left & {"shared", "members", "words", "candidates", "unsettled", "leading", "met", "rest"}


def test_forest_follows_long_paths_to_their_end(spark):
    parents = [(n, n - 1 - n * 7 % min(n, 5)) for n in range(1, 300) if n % 60] + [(1000 + n, 60) for n in range(50)]
    end = {}
    for node, parent in sorted(parents):
        end[node] = end.setdefault(parent, parent)
    assert {r.node: r.root for r in components.forest(spark.createDataFrame(parents, "u int, v int")).collect()} == end
    assert components.forest(spark.createDataFrame([], "u int, v int")).isEmpty()


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(20)] + [("100", f"{i}") for i in range(101, 140)] + [("200", "200")]
    found = components.components(spark.createDataFrame(edges, "u string, v string"))
    root = {r.node: r.root for r in found.collect()}
    assert {root[f"{i:03d}"] for i in range(21)} == {"000"} and {root[str(i)] for i in range(100, 140)} == {"100"}
    assert len(root) == 61
    assert components.components(spark.createDataFrame([], "u string, v string")).count() == 0


@pytest.fixture(scope="module")
def copies():
    """One text with many near copies of different lengths of change, exact copies, and unrelated texts with a
    passage in common."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(150):
        near = list(base)
        for _ in range(rng.randint(1, 25)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [texts[0]] * 20
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(120):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(80, 200)))
        texts.append(f"{own} {shared} {own[:90]}")
    return texts


def test_classes_equal_brute_force(spark, copies):
    words = [near_dedup.words_of(t) for t in copies]
    code = {w: i for i, w in enumerate({w for t in words for w in t})}
    coded = [np.array([code[w] for w in t]) for t in words]
    pairs = [(a, b) for a in range(len(copies)) for b in range(a) if abs(len(words[a]) - len(words[b])) <= 0.2 * len(words[a])]
    similar = alignment.within([(coded[a], coded[b]) for a, b in pairs], 0.8)
    expected = roots(len(copies), [p for p, s in zip(pairs, similar, strict=True) if s])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, copies)).collect()}
    assert [got[i] for i in range(len(copies))] == expected
    kept = near_dedup.keep_first(frame(spark, copies))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_the_whole_table_against_all_candidates(spark, sample):
    """Every pair with a common run of five words, aligned."""
    rows = spark.read.parquet(f"{sample}/documents.parquet").orderBy("doc_id").collect()
    words = [near_dedup.words_of(r.text) for r in rows]
    code: dict[str, int] = {}
    coded = [np.array([code.setdefault(w, len(code)) for w in t]) for t in words]
    where: dict[tuple, set[int]] = {}
    for i, t in enumerate(words):
        for k in range(max(1, len(t) - 4)):
            where.setdefault(tuple(t[k : k + 5]), set()).add(i)
    pairs = sorted({(a, b) for group in where.values() for a in group for b in group if b < a})
    similar = alignment.within([(coded[a], coded[b]) for a, b in pairs], 0.8)
    expected = roots(len(rows), [p for p, s in zip(pairs, similar, strict=True) if s])
    got = {r.doc_id: r for r in queries.op4_order_minhash(spark, sample).collect()}
    assert [got[r.doc_id].class_id for r in rows] == [rows[i].doc_id for i in expected]
    assert all(got[rows[i].doc_id].class_size == expected.count(root) for i, root in enumerate(expected))


def scattered(rng, base, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in base]


def test_noisy_copies_meet_their_original_without_being_centre(spark):
    """1,000 copies with 15 % of the words replaced align with the original and not with each other."""
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    words = [base] + [scattered(rng, base, 0.15, vocabulary) for _ in range(1000)]
    coded = [np.array([int(w[1:]) for w in t], np.uint16) for t in words]
    pairs = [(a, b) for a in range(len(words)) for b in range(a) if b == 0 or (coded[a] == coded[b]).mean() > 0.75]
    similar = alignment.within([(coded[a], coded[b]) for a, b in pairs], 0.8)
    expected = roots(len(words), [p for p, s in zip(pairs, similar, strict=True) if s])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, [" ".join(t) for t in words])).collect()}
    found = sum(got[i] == 0 for i in range(len(words)))
    assert all(expected[i] == 0 for i in got if got[i] == 0)
    assert found >= 0.9 * expected.count(0)


def test_scattered_edits_are_found(spark):
    """One copy each with 10 to 20 % of the words replaced; nine in ten of those that align are linked."""
    rng = random.Random(20)
    vocabulary, texts, linked = [f"w{i}" for i in range(4000)], [], []
    for k in range(400):
        base = [rng.choice(vocabulary) for _ in range(300)]
        near = scattered(rng, base, rng.uniform(0.10, 0.20), vocabulary)
        texts += [" ".join(base), " ".join(near)]
        coded = [np.array([int(w[1:]) for w in t], np.uint16) for t in (base, near)]
        linked.append(bool(alignment.within([tuple(coded)], 0.8)[0]))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, texts)).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(400)]
    assert not any(f and not x for f, x in zip(found, linked, strict=True))
    assert sum(found) >= 0.9 * sum(linked)


def test_a_passage_in_all_texts_links_none(spark):
    """Every text holds one long line, so that its buckets hold all texts; the pairs among them are found all the same."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for k in range(300):
        own = [rng.choice(vocabulary) for _ in range(50)]
        at = rng.randint(0, 50)
        near = scattered(rng, own, 0.04, vocabulary)
        texts += [" ".join(x[:at] + line + x[at:]) for x in (own, near)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, texts)).collect()}
    assert all(got[i] in (i, i - i % 2) for i in range(600))
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 290


def test_odd_rows_have_classes(odd_docs, no_docs):
    rows = near_dedup.classes(odd_docs).collect()
    assert len(rows) == 12
    assert {r.class_id for r in rows if r.doc_id in (3, 4, 5)} == {3, 5}  # blank is not empty, null is
    assert {r.class_id for r in rows if r.doc_id == 2} == {1}
    kept = near_dedup.keep_first(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "3", "5", "6", "7", "8", "None"])
    assert near_dedup.classes(no_docs).count() == near_dedup.keep_first(no_docs).count() == 0


@pytest.fixture(scope="module")
def hosts(spark, sample):
    return [r.text for r in spark.read.parquet(f"{sample}/documents.parquet").orderBy("doc_id").limit(150).collect()]


@pytest.mark.parametrize("punctuated", [True, False])
def test_planted_passages_go_from_all_but_the_first(spark, hosts, punctuated):
    """Passages of 51 words and more, put into the middle of sentences."""
    rng = random.Random(2)
    vocabulary = [w for t in hosts[:40] for w in t.split()]
    texts, planted = [f"Text number {i} begins here. {t}" for i, t in enumerate(hosts)], []
    for k in range(0, 60, 3):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(51, 70))]
        if not punctuated:
            words = [w.strip(".,!?") or "x" for w in words]
        planted.append((k, words))
        for i in range(k, k + 3):
            host = texts[i].split(" ")
            at = rng.randint(5, len(host))
            texts[i] = " ".join([*host[:at], *words, *host[at:]])
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    for k, words in planted:
        assert " ".join(words) in got[k]
        for i in (k + 1, k + 2):
            pieces = [" ".join(words[a : a + 25]) for a in range(len(words) - 24)]
            assert not any(p in got[i] for p in pieces)


def plain_removal(texts):
    """The same rule with dictionaries: the runs of each text in the order of ids."""
    cutter, first, out = substring_dedup.Cutter(), {}, []
    cut = []
    for i, text in enumerate(texts):
        words = text.split()
        hashes = cutter.hashes(text)
        starts = cutter.sentences(text, hashes)
        runs = []
        for s in range(len(starts) - 1):
            e = s + substring_dedup.RUN
            while e < len(starts) and starts[e] - starts[s] < substring_dedup.WORDS:
                e += 1
            if e < len(starts):
                run = tuple(words[starts[s] : starts[e]])
                first.setdefault(run, (i, s))
                runs.append((s, e, run))
        cut.append((words, starts, runs))
    for i, (words, starts, runs) in enumerate(cut):
        gone = {w for s, e, run in runs if first[run] != (i, s) for w in range(starts[s], starts[e])}
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def test_removal_equals_dictionaries(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op5_sentence_spans(spark, sample).collect()}
    expected = plain_removal([r.text for r in rows])
    for row, words in zip(rows, expected, strict=True):
        new = got[row.doc_id]
        assert new.text.split() == words
        assert (new.lang, new.source, new.n_chars) == (row.lang, row.source, row.n_chars)
        if len(words) == len(row.text.split()):
            assert new.text == row.text


def test_odd_rows_keep_their_columns(odd_docs, no_docs):
    changed = substring_dedup.remove_repeats(odd_docs)
    assert changed.schema == odd_docs.schema
    rows = changed.collect()
    assert len(rows) == 12 and {r.text for r in rows if r.doc_id == 2} == {""}
    assert {r.text for r in rows if r.doc_id == 3} == {None} and {r.text for r in rows if r.doc_id == 5} == {" \n\t "}
    assert sum((r.text or "").startswith("The first sentence") for r in rows) == 2
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_leaks_of_the_whole_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").collect()
    items = spark.read.parquet(f"{sample}/benchmark.parquet").collect()
    expected = {(d.doc_id, i.item_id) for d in docs for i in items if " ".join(i.text.split()) in " ".join(d.text.split())}
    got = {(r.doc_id, r.item_id) for r in queries.op6_template_decontamination(spark, sample).collect()}
    assert expected and got == expected


ITEM = "Today Maria buys 12 apples for 5 dollars each and then Maria sells 12 of the apples to Tom near the market today."


@pytest.mark.parametrize(
    "text, caught",
    [
        (ITEM, True),
        ("Some words before it. " + ITEM.replace("Maria", "Anna Lee").replace("12", "3.5") + " And after it.", True),
        (ITEM.replace("12", "7", 1), True),  # 13 words and more are as they were
        (ITEM.replace("Maria", "Anna", 1), True),
        ("Maria buys 12 apples.", False),
    ],
)
def test_slots_must_be_consistent(spark, text, caught):
    items = spark.createDataFrame([(7, ITEM), (8, ITEM.replace("Maria", "Eva")), (9, None), (10, "too short")], "item_id long, text string")
    found = decontam.matches(frame(spark, [text], 40), items, share=0.8).collect()
    assert [(r.doc_id, r.item_id) for r in found] == ([(40, 7)] if caught else [])


def sides(*slots):
    """A window from (kind, item value, document value) triples."""
    pair = lambda k, v: {"kind": k, "value": v}
    return {"at": 0, "size": 8, "common": False, "item": [pair(k, i) for k, i, _ in slots], "doc": [pair(k, d) for k, _, d in slots]}


def test_windows_count_by_their_slots():
    name, number = decontam.CAPITAL, decontam.NUMBER
    counts = lambda *windows: [w in decontam.counting(list(windows)) for w in windows]
    assert counts(sides((number, "3", "4")), sides((number, "5", "4"))) == [True, True]  # two numbers may become one
    assert counts(sides((number, "3", "4")), sides((number, "3", "4")), sides((number, "3", "7"))) == [True, True, False]
    assert counts(sides((name, "Tom", "Eva")), sides((name, "Tom", "Eva")), sides((name, "Ann", "Eva"))) == [True, True, False]
    assert counts(sides((name, "Tom", "Eva")), sides((name, "Tom", "Eva")), sides((name, "Tom", "Tom"))) == [True, True, True]
    assert counts(sides((number, "3", "3")), sides((name, "3", "Eva"))) == [True, True]  # types are apart


UNUSUAL = [
    "Compute 12 + 7 * 3 - 5 .", "What is 7 times 8?", "Solve 3x + 4 = 19 for x.", "Who wrote Hamlet?",
    "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u3001\u6559\u3048\u3066\u304f\u3060\u3055\u3044",
]


def test_items_without_plain_windows_are_found_as_written(spark):
    items = spark.createDataFrame([*enumerate(UNUSUAL, 1), (9, "Paris")], "item_id long, text string")
    texts = [f"Some words before. {x} And some behind." for x in UNUSUAL]
    texts += [x.replace("7", "9").replace("3", "6").replace("Hamlet", "Faust").replace("\u9996", "\u5317") for x in texts]
    texts += ["In Paris it rains.", "Paris!", "compute 12 + 7", "\u524d\u7f6e\u304d" + UNUSUAL[4] + "\u5f8c"]
    found = {(r.doc_id, r.item_id) for r in decontam.matches(frame(spark, texts), items).collect()}
    # The sentence in Japanese has plain windows, of which one change leaves more than half.
    assert found == {*((i, i + 1) for i in range(5)), (9, 5), (11, 9), (13, 5)}


def test_excerpts_of_long_items(spark):
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(200)]
    noise = lambda n: [rng.choice(vocabulary) + "x" for _ in range(n)]
    near = [w + "y" if k % 10 == 9 else w for k, w in enumerate(item)]
    cut = [item[50:150], item[20:33], item[20:32], near]
    texts = [" ".join(noise(30) + part + noise(30)) for part in cut]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.matches(frame(spark, texts), items).collect()) == [0, 1]


def test_reparameterised_items_equal_a_plain_search(spark, sample):
    """Every fifth item with other numbers, and in every second of these other names, in clean hosts."""
    items = [r for r in spark.read.parquet(f"{sample}/benchmark.parquet").orderBy("item_id").collect()]
    hosts = [" ".join(f"host{i}word{k}" for k in range(40)) for i in range(len(items))]
    changed = []
    for i, item in enumerate(items):
        words = item.text.split()
        new = [w.replace("1", "7").replace("2", "8") if any(c.isdigit() for c in w) else w for w in words]
        changed.append(" ".join(new))
    texts = [f"{h} {t}" if i % 2 else h for i, (h, t) in enumerate(zip(hosts, changed, strict=True))]
    table = spark.read.parquet(f"{sample}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.matches(frame(spark, texts), table).collect()}
    assert {(i, item.item_id) for i, item in enumerate(items) if i % 2} <= found
    assert {i for i, _ in found} == {i for i in range(len(items)) if i % 2}


NAMED = "Tom has 5 red apples in his bag. Anna has 3 green apples in her bag. Ben buys 4 yellow apples at the shop."


def test_names_that_start_sentences(spark):
    text = "Some words. " + NAMED.replace("Tom", "Eva").replace("Anna", "John").replace("Ben", "Mia Lee").replace("4", "7")
    items = spark.createDataFrame([(1, NAMED)], "item_id long, text string")
    docs = frame(spark, [text, "Then Eva" + NAMED[3:], NAMED.replace("apples", "pears")])
    assert sorted(r.doc_id for r in decontam.matches(docs, items, share=0.5).collect()) == [0, 1]


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a text of some words"), (2, None), (None, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.matches(odd_docs, items).collect()] == [(None, 1)]
    clean = decontam.clean_documents(odd_docs, items)
    assert clean.schema == odd_docs.schema and clean.count() == 11
    assert decontam.clean_documents(odd_docs, items.limit(0)).count() == 12
    assert decontam.matches(no_docs, items).count() == 0


def chains(rng, vocabulary, steps):
    """Texts that hold one line, each near the one before it and far from the others: the line's buckets hold them all."""
    line = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(30):
        now = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(steps):
            texts.append(" ".join(now[:40] + line + now[40:]))
            now = list(now)
            for at in rng.sample(range(80), 20):
                now[at] = rng.choice(vocabulary)
    return texts


def test_links_without_a_centre_are_found(spark):
    """Every pair that shares a key and aligns is in one class, also in buckets of many classes."""
    rng = random.Random(31)
    texts = chains(rng, [f"w{i}" for i in range(5000)], 5)
    coded = [np.array([int(w[1:]) for w in t.split()], np.uint16) for t in texts]
    seeds = near_dedup.mixed(np.arange(1, near_dedup.SKETCHES + 1, dtype=np.uint64) * near_dedup.ODD)
    hashed = [np.array([near_dedup.xxhash.xxh64_intdigest(w) for w in t.split()], np.uint64) for t in texts]
    keys = [{(i, k) for i, k in enumerate(near_dedup.sketches(h, seeds))} for h in hashed]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if keys[a] & keys[b]]
    similar = alignment.within([(coded[a], coded[b]) for a, b in pairs], 0.8)
    linked = [p for p, s in zip(pairs, similar, strict=True) if s]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, texts)).collect()}
    assert len(linked) > 50 and all(got[a] == got[b] for a, b in linked)
    assert all(got[a] // 5 == a // 5 for a in got)


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9])
def test_rest_holds_every_link(spark, similarity):
    """Of texts of 1 to 40 words, all in one bucket and each a class, every pair that aligns is among the pairs."""
    rng = random.Random(32)
    texts = []
    for _ in range(60):
        now = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        for _ in range(4):
            texts.append(now)
            now = [rng.randrange(30) if rng.random() < 0.12 else w for w in now][: rng.randint(1, 44)]
    coded = list({np.array(t, np.uint16).tobytes() for t in texts})
    rows = [(k.to_bytes(2, "big"), bytearray(c), len(c) // 2) for k, c in enumerate(coded)]
    words = spark.createDataFrame([r[:2] for r in rows], "node binary, words binary")
    members = spark.createDataFrame([(1, r[0], r[2]) for r in rows], "key bigint, node binary, length int")
    roots = spark.createDataFrame([], "node binary, root binary")
    found = near_dedup.rest(members, roots, words, similarity).collect()
    got = {frozenset(int.from_bytes(x, "big") for x in r) for r in found}
    read = [np.frombuffer(c, np.uint16) for c in coded]
    pairs = [(a, b) for a in range(len(read)) for b in range(a)]
    similar = alignment.within([(read[a], read[b]) for a, b in pairs], similarity)
    links = {frozenset(p) for p, s in zip(pairs, similar, strict=True) if s}
    assert len(links) > 10 and links <= got


def test_rest_leaves_out_pairs_with_few_common_runs(spark):
    """Texts of one bucket that have one run of five words in common are no pairs, those that are a link are; small buckets give all links."""
    rng = random.Random(33)
    texts = [[rng.randrange(50_000) for _ in range(100)] for _ in range(60)]
    for k in range(0, 50, 2):
        texts[k + 1][20:25] = texts[k][40:45]
    for k in range(50, 60, 2):
        texts[k + 1] = texts[k][:45] + [rng.randrange(50_000) for _ in range(18)] + texts[k][63:]
    ids = [k.to_bytes(2, "big") for k in range(60)]
    rows = [(i, bytearray(np.array(t, np.uint16).tobytes())) for i, t in zip(ids, texts, strict=True)]
    words = spark.createDataFrame(rows, "node binary, words binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    links = {(k, k + 1) for k in range(50, 60, 2)}

    def found(buckets):
        members = spark.createDataFrame([(key, i, 100) for key, i in zip(buckets, ids, strict=True)], "key bigint, node binary, length int")
        rows = near_dedup.rest(members, roots, words, 0.8).collect()
        return {tuple(sorted(int.from_bytes(x, "big") for x in r)) for r in rows}

    assert found([1] * 60) == links
    assert links <= found([k // 10 for k in range(60)])


def test_words_of_letters_alone_need_no_patterns(monkeypatch):
    """They are coded as the patterns would code them, which all other words go through."""
    words = "Plain words, Über 12kg seven km Ünit ² ٣ _x Ⅷ ǅ 日本 (end.) A".split()
    whole = decontam.Canon()
    whole.templates(words)
    for word, code in whole.codes.items():
        bare = decontam.EDGES.sub("", word)
        kind = whole.kinds.get(bare.lower(), decontam.CAPITAL if bare[:1].isupper() else decontam.LITERAL)
        number = bool(decontam.NUMERIC.fullmatch(bare.strip("$€£")))
        assert whole.kind[code] == (decontam.NOTHING if not bare else decontam.NUMBER if number else kind)
        assert whole.ends[code] == (word.rstrip("\"')]")[-1:] in tuple(".!?"))
    monkeypatch.setattr(decontam, "EDGES", None)
    monkeypatch.setattr(decontam, "NUMERIC", None)
    decontam.Canon().templates([w for w in words if w.isalpha()])


def test_words_with_punctuation_around_letters_need_no_patterns(monkeypatch):
    words = "(end.) \"Plain,\" Über: ünit! 日本? -Ⅷ".split()
    by_patterns = [decontam.EDGES.sub("", w) for w in words]
    monkeypatch.setattr(decontam, "EDGES", None)
    canon = decontam.Canon()
    canon.templates(words[:-1])
    for word, bare in zip(words[:-1], by_patterns, strict=False):
        assert canon.kind[canon.codes[word]] == (decontam.CAPITAL if bare[0].isupper() else decontam.LITERAL)
        assert canon.ends[canon.codes[word]] == (word in ("(end.)", "ünit!", "日本?"))


def test_texts_together_have_their_own_templates():
    """Also where texts are empty, end with signs alone, or a name ends one text and starts the next."""
    texts = ["We met Anna Bell", "Carl Dee went. Eve paid 3 dollars |", "", "| -", "- Bob ate 12kg of them. | Next", "plain words only"] * 2
    split = [t.split() for t in texts]
    words = [w for s in split for w in s]
    together = decontam.Canon().templates(words, [len(s) for s in split])
    starts = np.cumsum([0] + [len(s) for s in split])
    for n, alone in enumerate(split):
        for number, template in enumerate(decontam.Canon().templates(alone)):
            whole = together[number]
            mine = whole.text == n
            for name in ("hashes", "holder", "place", "only"):
                assert getattr(whole, name)[mine].tolist() == getattr(template, name).tolist()
            assert (whole.start[mine] - starts[n]).tolist() == template.start.tolist()
            assert (whole.stop[mine] - starts[n]).tolist() == template.stop.tolist()
    for size in (1, 3):
        for template, start, _ in decontam.windows_both_ways(together, size):
            assert (template.text[start] == template.text[start + size - 1]).all()
    assert list(decontam.together(["ab", "", "c", "defg", "h"], 3)) == [["ab", "", "c"], ["defg"], ["h"]]
