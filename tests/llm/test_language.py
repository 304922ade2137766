"""Language identification against plain counting, and its accuracy on documents it has not seen."""

import math
import zlib

import numpy as np
import pytest

from loanfate.llm import language, queries
from loanfate.llm.common import read_documents

from .conftest import SF_DIR


def plain_trigrams(text):
    symbols = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in b" " + text.lower().encode() + b"  ")
    return [symbols[i:i + 3] for i in range(len(symbols) - 2) if b"  " not in symbols[i:i + 3]]


def bucket(gram):
    mixed = 0
    for b in gram:
        mixed = (mixed * 65_599 + b) % 2**32
    return mixed * 2_654_435_761 % 2**32 >> (32 - 15)


def test_trigrams(odd_texts):
    texts = [t or "" for t in odd_texts]
    buckets, counts = language.trigrams(texts)
    want = [[bucket(g) for g in plain_trigrams(t)] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert buckets.tolist() == [b for w in want for b in w]
    assert language.trigrams([])[0].size == 0


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 40])
def test_codewords_are_far_apart(n):
    words = language.codewords(n)
    assert set(np.unique(words)) == {-1, 1} and (np.abs(words.sum(axis=0)) < n).all()
    apart = [(a != b).mean() for i, a in enumerate(words) for b in words[:i]]
    assert min(apart) >= (0.5 if n <= 6 else 0.25)


def test_learned_weights_equal_plain_counts(spark, documents):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 8)]
    docs = documents([(i, t) for i, t, _ in rows]).drop("lang").join(
        spark.createDataFrame([(i, l) for i, _, l in rows], "doc_id long, lang string"), "doc_id")
    model = language.learn(docs)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts = {l: [0.5] * language.BUCKETS for l in ("de", "en", "fr")}
    for _, t, l in learned:
        for g in plain_trigrams(t):
            counts[l][bucket(g)] += 1
    assert model.languages == ["de", "en", "fr"]
    rates = {l: [x / sum(c) for x in c] for l, c in counts.items()}
    for k in range(model.words.shape[1]):
        one = [l for l, w in zip(model.languages, model.words[:, k]) if w > 0]
        zero = [l for l in model.languages if l not in one]
        for b in {bucket(g) for g in plain_trigrams("the der chien")}:
            ratio = sum(rates[l][b] for l in one) / len(one) / (sum(rates[l][b] for l in zero) / len(zero))
            assert math.isclose(model.weights[b, k], math.log(ratio), rel_tol=1e-4, abs_tol=1e-5)
    # Decoding by hand.
    margins = model.margins(["the dog"])[0]
    sums = [sum(model.weights[bucket(g), k] for g in plain_trigrams("the dog")) for k in range(len(margins))]
    assert np.allclose(margins, np.array(sums) / math.sqrt(len(plain_trigrams("the dog"))), atol=1e-5)
    loss = [sum(t * math.log1p(math.exp(-w * m)) for w, m, t in zip(word, margins, trust)) for word, trust in zip(model.words, model.trust)]
    share = math.exp(-loss[1]) / sum(math.exp(-x) for x in loss)
    (answer,) = language.predictions(model, ["the dog"])
    assert answer[0] == "en" and math.isclose(answer[1], share, rel_tol=1e-6)


def test_held_out_accuracy(spark):
    docs = read_documents(spark, "/root/testdata/sf0.01")
    rows = queries.op4_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, documents, odd_texts):
    model = language.learn(read_documents(spark, SF_DIR))
    rows = [*enumerate(odd_texts), (None, "no id, but words"), (103, "again"), (103, "again")]
    got = language.identify(documents(rows), model).collect()
    assert len(got) == len(rows)
    unknown = sorted(str(r.doc_id) for r in got if r.lang_pred == "und")
    assert unknown == sorted(str(i) for i, t in rows if not any(c.isalpha() for c in t or ""))
    assert all((r.score, r.ambiguous) == (0.0, False) for r in got if r.lang_pred == "und")
    kept = language.identified_documents(documents(rows), model)
    assert kept.columns == documents([]).columns
    assert {str(r.doc_id) for r in kept.collect()}.isdisjoint(unknown)
    assert language.identify(documents([]), model).count() == 0


def test_nothing_or_one_language_learned(spark, documents):
    empty = language.learn(documents([(1, "words without a language")]))
    assert [r.lang_pred for r in language.identify(documents([(1, "some words")]), empty).collect()] == ["und"]
    one = language.learn(read_documents(spark, SF_DIR).filter("lang = 'fr'"))
    (row,) = language.identify(documents([(1, "some words")]), one).collect()
    assert (row.lang_pred, row.score, row.ambiguous) == ("fr", 1.0, False)
