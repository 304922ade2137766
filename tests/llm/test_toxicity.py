"""Weights by the Kneser-Ney formulas, the curve's fit, and planted expressions in unseen documents."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

from loanfate.llm import queries, toxicity
from loanfate.llm.common import read_documents

ORDINARY = [f"word{i}" for i in range(300)]
RUDE = [f"rude{i}" for i in range(6)]


def corpus(n=900, seed=3):
    """(doc_id, text, toxic): a toxic text has one or more rude words among ordinary ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(ORDINARY) for _ in range(rng.choice([3, 20, 200, 800]))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(RUDE))
        rows.append((i, " ".join(words), toxic))
    return rows


def frames(spark, documents, rows):
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return documents([(i, t) for i, t, _ in rows]), labels


def fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_training_rows(spark, documents):
    """All labelled rows outside the held-out fold, or about as many as asked, chosen by id whatever the order."""
    rows = corpus(300)
    docs, labels = frames(spark, documents, rows)
    training = toxicity.labelled(docs, labels).collect()
    assert sorted((r.text, r.toxic) for r in training) == sorted((t, x) for i, t, x in rows if fold(i, 3) != 1)
    some = toxicity.labelled(docs, labels, most_rows=80).collect()
    again = toxicity.labelled(docs.repartition(5), labels.repartition(2), most_rows=80).collect()
    assert 50 < len(some) < 110 and sorted(some) == sorted(again) and set(some) <= set(training)


def test_words_are_runs_of_letters_marks_and_digits(odd_texts):
    """The fast way for texts below U+0300 gives what the classes of Unicode say."""
    texts = [t or "" for t in odd_texts] + ["".join(map(chr, range(0x300))), "\u00bd\u00b2 x_y \u02c0\u00aa\u00d7", "\u0130\u0301 \u1e9e \u0660"]
    assert [toxicity.words_of(t) for t in texts] == [regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower()) for t in texts]


def test_curve_is_the_maximum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2)).round(1)
    y, n = rng.integers(0, 2, 40), rng.integers(1, 9, 40)
    w = toxicity.fit_curve(x, y, n)

    def loss(w):
        z = w[0] + x @ w[1:]
        return (n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (w[1:] ** 2).sum()

    assert all(loss(w) <= loss(w + d) for d in rng.normal(scale=0.05, size=(200, 3)))
    assert (toxicity.fit_curve(x, y * 0, n) == [-30, 0, 0]).all() and toxicity.fit_curve(x[:0], y[:0], n[:0])[0] == -30


def test_planted_expressions_in_unseen_documents(spark, documents):
    rows = corpus()
    docs, labels = frames(spark, documents, rows)
    model = toxicity.fit(docs, labels)
    truth = {i: x for i, _, x in rows}
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    unseen = [i for i in truth if fold(i, 3) == 1]
    assert all((scores[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in unseen)
    kept = toxicity.ordinary_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_query_ranks_toxic_documents_first(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf_dir).collect()
    assert len(rows) == read_documents(spark, sf_dir).count()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, ordinary = ([s for s, x in unseen if x == k] for k in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in ordinary) / (len(toxic) * len(ordinary))
    assert better > 0.75  # some fifty toxic texts to learn from


def test_odd_rows(spark, documents, odd_texts):
    rows = corpus(400)
    docs, labels = frames(spark, documents, [*rows, *((1000 + i, t, 1) for i, t in enumerate(odd_texts))])
    more = spark.createDataFrame([(None, 1, 1), (5, 0, None), (7, 0, 1), (7, 0, 0), (9, 0, 5)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.unionByName(more))
    asked = documents([*enumerate(odd_texts), (None, "rude1 here"), (77, "again"), (77, "again")])
    got = toxicity.score_texts(asked, model).collect()
    assert len(got) == asked.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {r.doc_id: r.score for r in got}
    assert by_text[0] == by_text[1] < toxicity.THRESHOLD < by_text[None]  # null as empty
    assert toxicity.score_texts(asked.limit(0), model).count() == 0


def test_nothing_or_one_class_to_learn_from(spark, documents):
    rows = corpus(60)
    docs, labels = frames(spark, documents, rows)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        scores = [r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, some)).collect()]
        assert max(scores) < 1e-9
    assert toxicity.score_texts(docs, toxicity.fit(docs.limit(0), labels)).count() == 60


def plain_mean(rows, corpus, text):
    """Log-likelihood ratio per word of interpolated Kneser-Ney models of three words, straight from the formulas."""
    c3 = [defaultdict(int), defaultdict(int)]
    for t, toxic in rows:
        words = ["<", "<", *toxicity.words_of(t), ">"]
        for run in zip(words, words[1:], words[2:]):
            c3[toxic][run] += 1
    c2 = [defaultdict(int), defaultdict(int)]
    c1 = [defaultdict(int), defaultdict(int)]
    for k in (0, 1):
        for _, v, w in c3[k]:
            c2[k][v, w] += 1
        for _, w in c2[k]:
            c1[k][w] += 1
    everywhere = defaultdict(int)
    for t in corpus:
        words = toxicity.words_of(t)
        for w in [*words, ">"] if words else []:
            everywhere[w] += 1
    known = {w for c in c1 for w in c}
    all_known = sum(everywhere[w] for w in known)

    def p(k, *run):
        if len(run) == 1:
            total, w = sum(c1[k].values()), run[0]
            shared = (everywhere[w] if w in known else 1) / all_known
            return max(c1[k][w] - 0.75, 0) / total + 0.75 * sum(n > 0 for n in c1[k].values()) / total * shared
        counts = c2[k] if len(run) == 2 else c3[k]
        following = [n for r, n in counts.items() if r[:-1] == run[:-1] and n]
        shorter = p(k, *run[1:])
        if not following:
            return shorter
        return max(counts[run] - 0.75, 0) / sum(following) + 0.75 * len(following) / sum(following) * shorter

    words = ["<", "<", *toxicity.words_of(text), ">"]
    # A word that neither class knows has the same share in both, times what both leave to the back-off.
    return sum(math.log(p(1, *r) / p(0, *r)) for r in zip(words, words[1:], words[2:])) / (len(words) - 2)


def counted_runs(spark, documents, rows, more=()):
    frame = spark.createDataFrame([(x, t, False) for t, x in rows], "toxic int, text string, for_curve boolean").repartition(3)
    counts = toxicity.trigram_counts(frame)
    words = np.sort([r.w for r in counts.select("w").distinct().collect()])
    everywhere = toxicity.corpus_counts(documents(list(enumerate([*(t for t, _ in rows), *more]))), words)
    return toxicity.run_weights(counts.selectExpr("u", "v", "w", "t0 + t1 AS t", "o0 + o1 AS o"), everywhere)


def test_sum_of_weights_is_the_kneser_ney_ratio(spark, documents):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 30))), int(rng.random() < 0.3)) for _ in range(30)]
    more = ["a a a b zz", "", "g " * 50, "never labelled words"]
    model = toxicity.packed(counted_runs(spark, documents, rows, more), np.zeros(3))
    texts = ["a", "a b c d e f g", "b a a a g", rows[0][0], " ".join("gfedcba" * 5), "a"]
    got = model.features([*texts, "", "!"], {})[:, 1]
    want = [plain_mean(rows, [*(t for t, _ in rows), *more], t) for t in texts]
    assert np.allclose(got, [*want, 0, 0], rtol=1e-4, atol=1e-5) and min(want) < 0 < max(want)  # both signs


def test_shared_counts_cover_texts_without_a_label(spark, documents):
    """What is rare among labelled rows but frequent in the corpus tells less."""
    rows = [("a b c", 1), ("a c b", 0), ("rude a b", 1), ("c a b", 0)]
    alone, among = (toxicity.packed(counted_runs(spark, documents, rows, more), np.zeros(3)) for more in ([], ["rude"] * 400))
    assert 0 < among.features(["rude"], {})[0, 1] < 0.8 * alone.features(["rude"], {})[0, 1]


def test_toxic_run_of_ordinary_words(spark, documents):
    """Three words that both classes use alike are toxic one after the other only."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [rng.choice(ORDINARY) for _ in range(40)]
        toxic = int(rng.random() < 0.3)
        at = rng.randrange(30)
        words[at:at + 3] = ["red", "cold", "fish"] if toxic else rng.choice(
            [["red", "fish", "cold"], ["fish", "cold", "red"], ["cold", "red", "fish"], ["cold", "fish", "red"]])
        rows.append((i, " ".join(words), toxic))
    docs, labels = frames(spark, documents, rows)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == bool(x) for i, _, x in rows if fold(i, 3) == 1)


def test_every_run_has_a_weight(spark, documents):
    """No floor: one-off words and words of the ordinary class are in the model, each once."""
    texts = [(f"one{i} two{i} three{i}", i % 2) for i in range(40)] + [("often said", 1), ("often heard", 0)]
    found = counted_runs(spark, documents, texts).collect()
    weights = {r.run: r for r in found}
    runs = set()
    for t, _ in texts:
        runs |= set(toxicity._run_ids(toxicity._hashes(t, {})).tolist())
    # The words before a text are a history, too, and every run has one row.
    assert runs <= set(weights) and len(found) == len(weights)
    assert all(weights[toxicity.long_hash(f"one{i}")].ratio * (1 if i % 2 else -1) > 0 for i in range(40))


def test_rows_of_the_curve_are_counted_too(spark, documents):
    """Every training row has a word of its own, and the model knows all of them."""
    rows = [(i, f"own{i} {t}", x) for i, t, x in corpus(200)]
    docs, labels = frames(spark, documents, rows)
    runs = set(toxicity.fit(docs, labels).runs.tolist())
    assert all((toxicity.long_hash(f"own{i}") in runs) == (fold(i, 3) != 1) for i, _, _ in rows)


def test_model_beyond_its_bound_raises(spark, documents, monkeypatch):
    docs, labels = frames(spark, documents, corpus(60))
    monkeypatch.setattr(toxicity, "MOST_RUNS", 10)
    with pytest.raises(ValueError, match="most_rows"):
        toxicity.fit(docs, labels)
