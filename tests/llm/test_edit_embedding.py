"""Walks step by step, edited texts walked anew, and near classes by all pairs."""

import hashlib
import random

import numpy as np
import pytest

from loanfate.llm import edit_embedding as ee
from loanfate.llm import queries
from loanfate.llm.common import read_documents

from .conftest import SF_DIR

WALKS = ee.shared_walks()


def plain_print(text):
    """One character and one step at a time."""
    if not text:
        return bytes(WALKS.samples)
    written = []
    points = ee.code_points(text)
    for start, point in zip(WALKS.class_starts(points).tolist(), points.tolist()):
        stay = WALKS.stay[start + len(written) % ee.PERIOD]
        written += [point] * int(stay)
    at = np.array([max(int(p) for p in r if p < len(written)) for r in WALKS.records])
    return WALKS.kept(np.array(written, np.uint32)[at], at).tobytes()


def test_walks_of_many_texts_equal_plain_ones(odd_texts, monkeypatch):
    texts = [t or "" for t in odd_texts]
    want = [plain_print(t) for t in texts]
    for few in (0, 3, 48):
        monkeypatch.setattr(ee, "FEW", few)
        assert ee.Prints(WALKS, texts).own() == want


def edited_text(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def check_rows(rows, got):
    """``rows`` (doc_id, text) in the order of next documents."""
    texts = [t or "" for _, t in rows]
    prints = [p for t in texts for p in ee.Prints(WALKS, [t]).own()]
    want = []
    for k, (i, _) in enumerate(rows):
        n = (k + 1) % len(rows)
        edited = edited_text(texts[k], texts[n])
        (print_edited,) = ee.Prints(WALKS, [edited]).own()
        want.append((i, len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), ee.fingerprint_hex(prints[k]),
                     ee.fingerprint_hex(print_edited), ee.likeness(prints[k], print_edited), ee.likeness(prints[k], prints[n]),
                     ee.bands_shared(prints[k], print_edited), ee.bands_shared(prints[k], prints[n])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query(spark):
    rows = sorted(tuple(r) for r in read_documents(spark, SF_DIR).select("doc_id", "text").collect())
    check_rows(rows, queries.op2_edit_embedding(spark, SF_DIR).collect())


def test_odd_rows(spark, documents, odd_texts, monkeypatch):
    rows = [(None, "no id"), *((3 * i, t) for i, t in enumerate(odd_texts)), (90, "a"), (90, "b"), (90, "b")]
    check_rows(rows, ee.compare_with_next(documents(rows)).collect())
    check_rows([(4, "alone here")], ee.compare_with_next(documents([(4, "alone here")])).collect())
    check_rows([(4, "x"), (4, "x"), (4, "yy")], ee.compare_with_next(documents([(4, "x"), (4, "yy"), (4, "x")])).collect())
    assert ee.compare_with_next(documents([])).count() == 0
    got = ee.fingerprint_documents(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), ee.fingerprint_hex(plain_print(t or ""))) for i, t in rows)


def test_chunks_do_not_change_results(spark, documents, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, None)]
    run = ee._compare_rows(ee.SAMPLES, ee.SEED)
    import pyarrow as pa

    table = [(False, i, t or "") for i, t in enumerate(odd_texts)] + [(True, 99, "the next one")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("beyond", "doc_id", "text"), r)) for r in table[k:k + 4]]) for k in range(0, len(table), 4)]
    results = []
    for size in (1, 1000, 10**9):
        ee.CHARS_AT_ONCE, kept = size, ee.CHARS_AT_ONCE
        results.append([r for b in run(batches) for r in b.to_pylist()])
        ee.CHARS_AT_ONCE = kept
    assert len(results[0]) == len(rows) - 1 and results[0] == results[1] == results[2]


def noisy(text, share, rng):
    out = list(text)
    for _ in range(int(len(out) * share)):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[k:k + 1] = [["#"], ["#", out[k]], []][kind]
    return "".join(out)


def test_likeness_follows_the_edits():
    rng = random.Random(2)
    mean = []
    for share in (0.0, 0.002, 0.01, 0.05):
        found = []
        for _ in range(20):
            text = "".join(rng.choice("abcdefghij  ") for _ in range(2000))
            found.append(ee.likeness(*ee.Prints(WALKS, [text, noisy(text, share, rng)]).own()))
        mean.append(np.mean(found))
    assert mean[0] == 1 and mean[0] > mean[1] > mean[2] > mean[3] and mean[1] > 0.85
    a, b = ("".join(rng.choice("abcdefghij  ") for _ in range(2000)) for _ in range(2))
    assert ee.likeness(*ee.Prints(WALKS, [a, b]).own()) < 0.3


@pytest.mark.parametrize("block", [5, 2048])
def test_near_classes(spark, block):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij  ") for _ in range(1500)) for _ in range(12)]
    texts += [noisy(t, 0.001, rng) for t in texts[:6] for _ in range(4)] + texts[:3]
    prints = [p for p in ee.Prints(WALKS, texts).own()]
    frame = spark.createDataFrame([(ee.fingerprint_hex(p),) for p in prints] + [(None,)], "fingerprint string")
    got = {}
    for r in ee.near_classes(frame, block=block).collect():
        got.setdefault(r.class_fingerprint, set()).add(r.fingerprint)
    distinct = sorted(set(prints))
    label = list(range(len(distinct)))
    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct[:i]):
            if ee.likeness(a, b) >= ee.NEAR and ee.bands_shared(a, b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    groups = {}
    for x, p in zip(label, distinct):
        groups.setdefault(x, set()).add(ee.fingerprint_hex(p))
    assert {min(g): g for g in groups.values() if len(g) > 1} == got
