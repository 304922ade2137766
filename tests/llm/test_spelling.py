import random
import re
import zlib
from collections import Counter

import pytest

from loanfate.llm import queries, spelling
from loanfate.llm.common import read_documents

from .conftest import SF_DIR


def plain_words(rows, least_chars=7, least_count=2, drop_every=31):
    counts = Counter()
    for doc_id, text in rows:
        for found in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_near(words):
    """Near words by the strings that each word's deletions leave, each candidate then checked step by step."""
    by_rest, near = {}, {w: set() for w in words}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_rest.setdefault(rest, []).append(w)
    for group in by_rest.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def plain_forms(words, ratio=10):
    near = plain_near(words)
    forms = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= ratio * words[w]:
                forms[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(rows)


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def random_words(seed, n, letters, lengths):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([2, 3, 20, 45, 500, 7000]) for _ in range(n)}


@pytest.mark.parametrize("most_compared", [256, 3, 1])
@pytest.mark.parametrize("words", [
    random_words(1, 700, "ab", [1, 2, 3, 7, 8, 9]), random_words(2, 900, "a\u00e9\U0001f600z", [4, 5, 6]),
    random_words(3, 400, "abcdefgh", [7, 8]), {"a" * k: 10 ** (k % 5) for k in range(1, 40)},
], ids=["two letters", "wide letters", "eight letters", "runs"])
def test_forms_equal_brute_force(spark, words, most_compared):
    assert all(len(near) == sum(one_edit(w, o) for o in words) for w, near in plain_near(words).items())
    found = spelling.spelling_forms(table(spark, words), most_compared=most_compared)
    assert sorted(map(tuple, found.collect())) == plain_forms(words)


def test_hot_rest_is_cut_up(spark):
    """A third of all words share their first half: they meet in small groups, and each pair is found once."""
    rng = random.Random(4)
    hot = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)): rng.randint(2, 90) for _ in range(800)}
    words = hot | random_words(5, 1600, "abcdefghij", [10, 11, 12, 13])
    pairs = [tuple(r) for r in spelling.near_words(table(spark, words), most_compared=20).collect()]
    near = plain_near(words)
    assert sorted(pairs) == sorted((w, o, words[o]) for w in words for o in near[w])


def test_long_words(spark):
    long = "x" * 5_000
    words = {long: 100, long + "y": 4, long[:2_500] + "z" + long[2_501:]: 3, "y" * 4_999: 2, "z" * 60_000: 2, "z" * 60_001: 900}
    found = spelling.spelling_forms(table(spark, words))
    assert sorted(map(tuple, found.collect())) == plain_forms(words)


def test_words_of_odd_texts(spark, documents, odd_texts):
    """Nulls, empty and long texts, repeated rows, a null id, marks within the range of letters."""
    texts = [*odd_texts, "ABCDEFGH abcdefgh \u00c9tudiante \u00d7\u00f7\u00ff\u00c0abcd", "abcdefgh " * 3_000, "q" * 90_000 + " " + "q" * 90_000]
    rows = [*enumerate(texts), (18, texts[18]), (18, texts[18]), (None, "abcdefgh abcdefgh")]
    for every in (31, 2, 0):
        found = spelling.counted_words(documents(rows), drop_every=every)
        assert dict(map(tuple, found.collect())) == plain_words(rows, drop_every=every)


def test_no_rows(spark, documents):
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, None), (2, "short words only")])).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_documents(spark, SF_DIR).collect()]
    found = queries.op13_spelling(spark, SF_DIR)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == plain_forms(plain_words(rows))
