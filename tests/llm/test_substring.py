import random
import re
from collections import Counter

import numpy as np
import pytest

from loanfate.llm import substring
from loanfate.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def plain(rows, window):
    """Words left by counting the windows of all rows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    counts = Counter(tuple(w[s:s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if counts[tuple(words[s:s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_repeated_windows(seed):
    rng = random.Random(seed)
    for _ in range(15):
        symbols, window = rng.choice([1, 2, 3, 50]), rng.choice([1, 3, 5, 35])
        given = [[rng.randint(1, symbols) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(0, 12))]
        given += [list(s) for s in given[:2]]
        given += [s[:len(s) // 2] + [1] + s[len(s) // 2 + 1:] for s in given[:1] if len(s) > 4]
        weights = [rng.choice([1, 1, 1, 2]) for _ in given]
        counts = Counter()
        for s, n in zip(given, weights):
            for i in range(len(s) - window + 1):
                counts[tuple(s[i:i + window])] += n
        index = FMIndex([np.array(s, np.int64) for s in given], np.array(weights, np.int64), symbols)
        found = [(u, i) for u, a, b in zip(*index.repeated(window)) for i in range(a, b + 1)]
        assert sorted(found) == [
            (u, i) for u, s in enumerate(given) for i in range(len(s) - window + 1) if counts[tuple(s[i:i + window])] > 1
        ]


def test_suffixes_and_ranks():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 400)
    ends = np.array([99, 100, 250, 399])
    text[ends] = 0
    order = suffix_order(text, ends)
    name = {e: k - len(ends) for k, e in enumerate(ends)}
    keys = [[name.get(j, int(text[j])) for j in range(i, 400)] for i in range(400)]
    assert order.tolist() == sorted(range(400), key=lambda i: keys[i])
    held = WaveletMatrix(text, 2)
    for c in range(4):
        at = np.arange(401)
        rank = held.place(np.full(401, c), at) - held.place(np.array([c]), np.array([0]))
        assert rank.tolist() == [int((text[:i] == c).sum()) for i in at]


@pytest.mark.parametrize("most", [1, 3, 17, 1000])
def test_words_hash_alike_in_pieces_of_any_size(most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("ab  \n\u00e9") for _ in range(rng.choice([0, 0, 1, 5, 60]))) for _ in range(80)] + ["", "  ", "x" * 50, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, text = substring.hashes_of_texts(data, offsets, substring.Powers(), most)
    words = [(i, w) for i, t in enumerate(texts) for w in substring.words_of(t)]
    assert text.tolist() == [i for i, _ in words]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for (_, w), h in zip(words, hashes.tolist())) and len(set(by_word.values())) == len(by_word)


def corpus(seed, n=60):
    """Copies, near copies, shared passages at odd places, periodic texts, texts within one word of a window."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "\u00e9t\u00e9", "x1"]) if rng.random() < 0.3 else f"w{rng.randint(0, 500)}"
    fresh = lambda k: [word() for _ in range(k)]
    passage, texts = fresh(50), []
    for _ in range(n):
        words = fresh(rng.choice([0, 5, 34, 35, 36, 120, 300]))
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20):]
        texts.append(words)
    texts += [list(t) for t in texts[:8]]
    for t in [list(t) for t in texts[8:30]]:
        for _ in range(len(t) // 60):
            t[rng.randrange(len(t))] = "changed"
        texts.append(t)
    texts += [["p", "q"] * 60, ["p", "q"] * 17 + ["p"], ["z"] * 35, ["y"] * 36, fresh(40) * 2, []]
    return [(i, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window, anchor, most_places, shard_stretches", [(35, 5, 1000, 8000), (35, 5, 3, 5), (8, 3, 10, 50), (4, 4, 1, 1), (1, 1, 2, 9)])
def test_kept_words_equal_counted_windows(spark, documents, window, anchor, most_places, shard_stretches):
    rows = corpus(window + most_places)
    found = substring.drop_repeated_words(documents(rows), window, anchor=anchor, most_places=most_places, shard_stretches=shard_stretches)
    assert got(found) == plain(rows, window)


def test_odd_texts(spark, documents, odd_texts):
    """Nulls, empty and very long texts, repeated rows, one doc_id with two texts, a null doc_id, white space beyond ASCII."""
    long = odd_texts[16]
    rows = [*enumerate(odd_texts), (40, long + " more"), (16, long), (7, "a b"), (7, " ".join(map(str, range(90)))), (8, " ".join(map(str, range(50)))),
            (None, " ".join(map(str, range(40, 95)))), (50, "nbsp\u00a0joins \x1c x \u2003 y " * 30)]
    for window, anchor in ((35, 5), (2, 2)):
        assert got(substring.drop_repeated_words(documents(rows), window, anchor=anchor)) == plain(rows, window)


def test_no_rows(spark, documents):
    assert got(substring.drop_repeated_words(documents([]))) == []
    assert got(substring.drop_repeated_words(documents([(1, None), (2, "")]))) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_shared_passage_is_counted_before_it_is_dealt(spark, documents):
    """One passage in a third of all texts: each shard gets its different windows, not its places."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"{i}-{rng.random()}" for _ in range(40)) + (" " + passage if i % 3 == 0 else "")) for i in range(300)]
    found = substring.drop_repeated_words(documents(rows, 8), most_places=20)
    assert got(found) == plain(rows, 35)


def test_anchors_do_not_depend_on_the_texts_taken_together(monkeypatch):
    rows = [(i, 7 * i, t) for i, t in corpus(3, 20)]
    batch = substring.pa.RecordBatch.from_arrays([substring.pa.array(c) for c in zip(*rows)], names=["id", "tk", "text"])

    def anchors():
        return [r for b in substring._anchor_rows(9, 3)([batch.slice(0, 30), batch.slice(30), batch.slice(0, 0)]) for r in b.to_pylist()]

    whole = anchors()
    for most in (1, 100, 5_000):
        monkeypatch.setattr(substring, "STRETCHED_BYTES", most)
        assert anchors() == whole and whole
