"""SimHash links and classes against all pairs."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loanfate.llm import queries, simhash
from loanfate.llm.common import read_documents, stored
from loanfate.llm.components import connected_components

from .conftest import CLASHES, SF_DIR


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values, budget=2):
    """Least index reachable, by comparing all pairs."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


def balls(n, centres, flips, seed):
    """Fingerprints in balls around a few centres, and as many anywhere."""
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centres)]
    near = [rng.choice(middle) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(flips))}) for _ in range(n)]
    return sorted(set(near + [rng.getrandbits(64) for _ in range(n)] + [0, 1, (1 << 64) - 1]))


def test_fingerprint_of_odd_texts(odd_texts):
    for text in [*odd_texts, "One", "one two", "a b c", "A b\tC\x0bd\x1ce f\x85g"]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
@pytest.mark.parametrize("depth", [0, 3])
def test_walk_finds_all_pairs_once(budget, depth, monkeypatch):
    monkeypatch.setattr(simhash, "NODES_AT_ONCE", 50)
    values = [v >> depth for v in balls(150, 3, 5, budget)] if depth else balls(150, 3, 5, budget)
    a = np.array(sorted(set(values)), np.uint64)
    got = [(int(i), int(j)) for x, y in simhash.walk_pairs(a, None, depth, budget) for i, j in zip(x, y)]
    want = {(i, j) for j in range(len(a)) for i in range(j) if (int(a[i]) ^ int(a[j])).bit_count() <= budget}
    assert len(got) == len(set(got)) and set(got) == want
    if not depth:
        b = np.array(balls(100, 3, 5, budget), np.uint64)
        got = [(int(i), int(j)) for x, y in simhash.walk_pairs(a, b, 0, budget) for i, j in zip(x, y)]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= budget}
        assert len(got) == len(set(got)) and set(got) == want


def test_top_of_the_trie_misses_no_pair():
    values = balls(400, 2, 6, 9)
    top = simhash.TrieTop(values[::7])
    leaf = np.searchsorted(np.array(top.starts, np.uint64), np.array(values, np.uint64), side="right") - 1
    pairs = set(top.pairs(2))
    assert len(pairs) == len(top.pairs(2))
    for j in range(len(values)):
        for i in range(j + 1):
            if (values[i] ^ values[j]).bit_count() <= 2:
                assert (min(leaf[i], leaf[j]), max(leaf[i], leaf[j])) in pairs


@pytest.mark.parametrize("leaf_size", [16, 10_000])
def test_classes_equal_all_pairs(spark, leaf_size):
    values = balls(300, 4, 6, 3)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values for _ in range(2)], "fp long").repartition(4)
    got = {r.fp: r.class_fp for r in simhash.near_duplicate_classes(prints, 2, leaf_size).collect()}
    groups = {}
    for v, c in zip(values, plain_classes(values)):
        groups.setdefault(c, []).append(simhash.signed(v))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for fp, c in got.items():
        found.setdefault(c, set()).add(fp)
    assert {frozenset(g) for g in found.values()} == want


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]}[shape]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    rows = connected_components(spark.createDataFrame([*edges, (None, 7777), (None, None)], "a long, b long")).collect()
    assert len(rows) == len(label)
    least = {}
    for r in rows:
        least[r.component] = min(r.node, least.get(r.component, r.node))
    assert {r.node: least[r.component] for r in rows} == label


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    rows = sorted(read_documents(spark, SF_DIR).select("doc_id", "text").collect())
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{v:016x}", rows[c].doc_id) for r, v, c in zip(rows, prints, plain_classes(prints))}
    got = queries.op5_simhash(spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


LONG = " ".join(f"w{i}" for i in range(200))
def changed(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("leaf_size", [8, 1 << 20])
def test_one_of_each_group_of_similar_texts(spark, documents, leaf_size):
    """One changed word in 200 leaves a similarity of 0.95; unrelated texts share no shingle."""
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(15)]
    rows, group = [], {}
    for g, words in enumerate(texts):
        for _ in range(rng.randrange(1, 9)):
            group[len(rows)] = g
            rows.append((len(rows), changed(words, 1, rng)))
    kept = [r.doc_id for r in simhash.one_of_each_group(documents(rows), leaf_size=leaf_size).collect()]
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert sorted(kept) == sorted(first.values())


ROWS = [(5, LONG), (3, LONG + "\n"), (9, LONG.upper()), (4, None), (2, ""), (8, " \n"), (7, "another text of a few words"),
        (7, "another text of a few words"), (None, LONG), (None, "alone without id"), (7, "same id, other words here")]


def test_odd_rows(spark, documents):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(ROWS)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, 3), (4, 2), (2, 2), (8, 2), (7, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_of_each_group(spark, documents):
    docs = documents(ROWS)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, LONG + "\n"), (2, ""), (7, "another text of a few words"), (7, "same id, other words here"),
                          (None, "alone without id")], key=str)
    assert simhash.one_of_each_group(documents([])).count() == 0


def plain_jaccard_classes(texts, size=5, similarity=0.8):
    """The least index of each text's class by comparing all shingle sets with each other."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))})
    label = list(range(len(texts)))
    for k, x in enumerate(sets):
        for j, y in enumerate(sets[:k]):
            if len(x & y) >= similarity * len(x | y):
                low, high = sorted((label[j], label[k]))
                label = [low if c == high else c for c in label]
    return label


def runs_changed(words, n, rng):
    """``n`` words in a row are new: a similarity of (196 - n - 4) / (196 + n + 4), for 200 words, or so."""
    at = rng.randrange(5, len(words) - n - 5)
    return " ".join([*words[:at], *(f"new{rng.random()}" for _ in range(n)), *words[at + n:]])


@pytest.mark.parametrize("leaf_size", [4, 1 << 20])
def test_groups_are_those_of_all_shingle_sets(spark, documents, leaf_size):
    """Isolated pairs on both sides of 0.8; a line held many times; many copies of one text that lack links to most."""
    rng = random.Random(12)

    def words():
        return [f"w{rng.randrange(100_000)}" for _ in range(200)]

    texts = []
    for n in range(8, 28):
        for _ in range(4):
            pair = words()
            texts += [" ".join(pair), runs_changed(pair, n, rng)]
    line = " ".join(f"line{i}" for i in range(12))
    texts += [" ".join([*[line] * 40, *words()[:60]]) for _ in range(8)]
    base = words()
    texts += [runs_changed(base, rng.choice([6, 12, 17, 22]), rng) for _ in range(60)]
    rng.shuffle(texts)
    label = plain_jaccard_classes(texts)
    assert 80 < len(set(label)) < len(texts) - 40
    kept = {r.doc_id for r in simhash.one_of_each_group(documents(list(enumerate(texts))), leaf_size=leaf_size).collect()}
    assert kept == set(label)


def test_repeated_lines_make_no_near_duplicates(spark, documents):
    """Texts that hold one line many times and differ in the rest stay: a set counts a shingle once."""
    rng = random.Random(13)
    line = " ".join(f"line{i}" for i in range(10))
    rows = [(i, " ".join([*[line] * 60, *(f"w{rng.random()}" for _ in range(40))])) for i in range(6)]
    assert sorted(r.doc_id for r in simhash.one_of_each_group(documents(rows)).collect()) == list(range(6))


def test_group_whose_members_are_near_one_of_them_only(spark, documents):
    """Copies with changes in different places are near the first text, but not near each other."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"new{rng.random()}" for _ in range(14)] + base[k + 14:]) for k in range(5, 180, 15)]
    label = plain_jaccard_classes([*texts, " ".join(base)])
    assert set(label) == {0} and len(set(plain_jaccard_classes(texts))) == len(texts)
    rows = list(enumerate([*texts, " ".join(base)]))
    for leaf_size in (2, 1 << 20):
        assert [r.doc_id for r in simhash.one_of_each_group(documents(rows), leaf_size=leaf_size).collect()] == [0]


def test_groups_are_searched_by_fingerprints_first(spark, documents, monkeypatch):
    """What SimHash links and the sets confirm is not asked again of the sets by the search for the rest."""
    asked = []
    near = simhash._near_pairs
    monkeypatch.setattr(simhash, "_near_pairs", lambda pairs, *rest: asked.append(pairs.distinct().collect()) or near(pairs, *rest))
    rows = [(i, LONG + f" end{i}") for i in range(6)]
    assert [r.doc_id for r in simhash.one_of_each_group(documents(rows)).collect()] == [0]
    prints = [plain_fingerprint(t) for _, t in rows]
    # Prints that link with another one, but for one of each class.
    linked = sum(c != i for i, c in enumerate(plain_classes(prints)))
    assert linked and len(asked[0]) == linked
    assert len(asked[1]) < len(rows) - 1


def test_print_pairs_connect_what_links_connect(spark):
    prints = [0, 0, 3, 7, 7 << 40, (7 << 40) + (1 << 60), 1 << 20]
    rows = [(100 + k, p) for k, p in enumerate(prints)]
    pairs = simhash.print_pairs(spark.createDataFrame(rows, "fp long, print long"))
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    assert set(got) == {100, 101, 102, 103, 104, 105, 106}
    assert len({got[k] for k in (100, 101, 102, 103, 106)}) == 1 and got[104] == got[105] != got[100]


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (held.apply(k).getName() for k in range(held.size())) if name.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).count(), "counts")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 20_000


def test_parity_sketches_bound_what_sets_differ_in():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 400))
        b = np.concatenate([a[rng.integers(0, 400):], rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(1, 300))])
        x, y = simhash.parity_sketch(a), simhash.parity_sketch(np.unique(b))
        apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert len(x) == simhash.SKETCH_BITS // 64 and apart <= len(set(a.tolist()) ^ set(b.tolist()))
    assert not simhash.parity_sketch(np.empty(0, np.int64)).any()


def test_sets_of_texts_that_share_one_line_are_not_made(spark, documents, monkeypatch):
    rng, made = random.Random(15), []
    sets = simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda texts, size: made.append(texts.count()) or sets(texts, size))
    line = " ".join(f"line{i}" for i in range(8))
    rows = [(i, " ".join([line, *(f"w{rng.random()}" for _ in range(200))])) for i in range(12)]
    assert sorted(r.doc_id for r in simhash.one_of_each_group(documents(rows)).collect()) == list(range(12))
    assert made and not any(made)


def test_groups_found_in_parts(spark, documents, monkeypatch):
    """Prefixes and pairs searched in several parts give the groups of all shingle sets."""
    rng, parts = random.Random(16), set()
    monkeypatch.setattr(simhash, "ENTRIES_AT_ONCE", 1000)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 1)
    met = simhash._met_sets
    monkeypatch.setattr(simhash, "_met_sets", lambda classed, part, *rest: parts.add(part) or met(classed, part, *rest))
    texts = []
    for n in range(10, 26):
        words = [f"w{rng.randrange(100_000)}" for _ in range(200)]
        texts += [" ".join(words), runs_changed(words, n, rng), runs_changed(words, n, rng)]
    texts += [None, "", "a short one", "A short  one"]
    rng.shuffle(texts)
    label = plain_jaccard_classes([t or "" for t in texts])
    kept = {r.doc_id for r in simhash.one_of_each_group(documents([*enumerate(texts)])).collect()}
    assert kept == set(label) and len(parts) > 1
