"""Phrases by plain search, matching statistics by trying all runs, and spans of changed licences."""

import random
import re

import pytest

from loanfate.llm import licenses, queries
from loanfate.llm.common import read_documents

from .conftest import SF_DIR

PHRASES = {label: text.split() for label, text in licenses.BASE_PHRASES.items()}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_row(doc_id, text):
    words = plain_words(text)
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def base_columns(r):
    return r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query(spark):
    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        docs = read_documents(spark, sf_dir).select("doc_id", "text").collect()
        rows = queries.op7_licenses(spark, sf_dir).collect()
        assert sorted(map(base_columns, rows)) == sorted(plain_row(r.doc_id, r.text) for r in docs)
        texts = {r.doc_id: r.text for r in docs}
        assert any(r.base_labels for r in rows)
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert ("gpl-3" in r.labels.split(",")) == ("GNU General Public License, version 3" in texts[r.doc_id])


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_all_runs(seed):
    rng = random.Random(seed)
    letters = "abcd"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(5)] + ["abab", "abab"]
    phrases = {f"p{k}": " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for k in range(4)}
    machine = licenses.LicenceAutomaton([(str(k), " ".join(t)) for k, t in enumerate(texts)], phrases)
    runs = {tuple(t[i:j]) for t in [*texts, *(p.split() for p in phrases.values())] for i in range(len(t)) for j in range(i, len(t) + 1)}
    stream = [rng.choice(letters + "x") for _ in range(300)]
    places, matches = machine.scan([w.encode() for w in stream])
    want = sorted((label, i) for label, p in phrases.items() for i in range(len(stream)) if stream[i:i + len(p.split())] == p.split()
                  and len(p.split()) >= 1)
    assert sorted(places) == want
    longest = [max(n for n in range(i + 2) if tuple(stream[i + 1 - n:i + 1]) in runs) for i in range(len(stream))]
    maximal = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(stream) or longest[i + 1] != n + 1)]
    assert [(a, n) for a, n, _ in matches] == maximal
    for first, n, state in matches:
        places = {(k, i + n) for k, t in enumerate(texts) for i in range(len(t)) if list(t[i:i + n]) == stream[first:first + n]}
        assert places == {(k, end) for k, ends in machine.states[state].ends.items() for end in ends}


def spans_of(text):
    machine = licenses.automaton(licenses.TEMPLATES, licenses.BASE_PHRASES)
    return machine.spans(machine.scan(licenses.words_of(text))[1])


def test_spans_survive_changes_and_ignore_prose():
    bsd = dict(licenses.TEMPLATES[::-1])["bsd"]
    words = bsd.split()
    changed = " ".join(["prose before"] + words[:6] + ["object"] + words[7:] + ["prose after"])
    (span,) = spans_of(changed)
    assert span[:2] == ("bsd", 2) and span[3] == len(words) - 1 and span[4] < 1
    assert [s[0] for s in spans_of(bsd.upper().replace(" ", " \n* "))] == ["bsd"]
    assert spans_of("the software is provided in source and binary forms to any person") == []
    half = " ".join(words[:len(words) // 2])
    assert spans_of(half) == [] and spans_of(half + " x" * 30 + " " + " ".join(words[len(words) // 2:])) == []


@pytest.mark.parametrize("seed", range(40))
def test_spans_equal_the_best_of_all_chains(seed):
    """Random templates and texts with repeats: every chain of matches is tried."""
    rng = random.Random(seed)
    letters = "abcde"
    templates = [[rng.choice(letters) for _ in range(rng.randrange(6, 14))] for _ in range(3)]
    text = []
    for _ in range(4):
        t = rng.choice(templates)
        cut, more = rng.randrange(len(t)), rng.choice([0, 2, 9, 12])
        text += t[:cut] + [rng.choice(letters + "xyz") for _ in range(more)] + t[rng.randrange(max(1, cut - 2), len(t) + 1) - 1:]
    machine = licenses.LicenceAutomaton([(str(k), " ".join(t)) for k, t in enumerate(templates)], {})
    matches = machine.scan([w.encode() for w in text])[1]
    for k, t in enumerate(templates):
        nodes = [(f, f + n, i, i + n) for f, n, _ in matches for i in range(len(t) - n + 1) if t[i:i + n] == text[f:f + n]]
        best = {}

        def extend(last, covered, start):
            key = start, last[1]
            best[key] = max(covered, best.get(key, 0))
            for q in nodes:
                if q[0] > last[0] and q[1] > last[1] and q[2] > last[2] and q[3] > last[3] and q[0] - last[1] <= licenses.MOST_GAP:
                    extend(q, covered + max(0, q[1] - q[0] - max(0, last[1] - q[0], last[3] - q[2])), start)

        for n in nodes:
            extend(n, n[1] - n[0], n[0])
        enough = {key: c for key, c in best.items() if c >= licenses.LEAST_SHARE * len(t)}
        spans = [(s[1], s[1] + s[2], s[3]) for s in machine.spans(matches) if s[0] == str(k)]
        assert bool(spans) == bool(enough)
        if enough:
            most = max(enough.values())
            assert max(s[2] for s in spans) == most
            assert all(best[a, b] == c for a, b, c in spans)
            # Whatever covers enough overlaps a span that covers as much at least.
            assert all(any(a < y and x < b and c <= z for x, y, z in spans) for (a, b), c in enough.items())


def test_grant_with_a_remark_inside(spark, documents):
    """The remark's words stand earlier in the template, which must not break the chain."""
    words = next(text for label, text in licenses.TEMPLATES if label == "mit" and len(text) > 60).split()
    text = " ".join([*words[:20], "note that permission is hereby granted by us", *words[20:]])
    (row,) = licenses.summarise(licenses.scan_documents(documents([(1, text)]))).collect()
    assert row.labels == "mit" and row.base_labels == "" and row.score == 1.0


def test_odd_rows(spark, documents, odd_texts):
    line = "Released Under\tthe MIT--License! cc by nc cc by nc"
    rows = [*enumerate(odd_texts), (50, line), (50, line), (None, line), (60, "under the mit licenses"), (61, "under the mit license " * 5000)]
    got = licenses.summarise(licenses.scan_documents(documents(rows))).collect()
    assert sorted(map(base_columns, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert {r.score for r in got if not r.labels} == {0.0}
    assert licenses.scan_documents(documents([])).count() == 0
