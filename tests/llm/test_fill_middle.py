import hashlib
import re

import numpy as np
import pytest

from loanfate.llm import fill_middle
from loanfate.llm.fill_middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer


@pytest.mark.parametrize("values", [
    np.arange(0), np.array([0]), np.array([7, 65_535, 65_536, 1 << 20]), np.arange(5_000),
    np.flatnonzero(np.random.default_rng(3).random(300_000) < 0.4), np.flatnonzero(np.random.default_rng(4).random(200_000) < 0.01),
    np.concatenate([np.arange(100, 70_000), np.arange(80_000, 80_003)]),
])
def test_select_gives_every_member(values):
    held = BoundarySet(values.astype(np.int64))
    assert len(held) == len(values)
    for k in {*range(0, len(values), max(1, len(values) // 500)), *range(max(0, len(values) - 3), len(values))}:
        assert held.select(k) == values[k]
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            held.select(k)


def test_each_form_of_container_is_used():
    rng = np.random.default_rng(5)
    some = np.sort(rng.choice(65_536, 1_000, replace=False)).astype(np.uint16)
    many = np.sort(rng.choice(65_536, 30_000, replace=False)).astype(np.uint16)
    made = [fill_middle.container(x) for x in (some, many, np.arange(9_000, dtype=np.uint16))]
    assert [type(c) for c in made] == [ArrayContainer, BitmapContainer, RunContainer]
    assert all(c.nbytes() <= fill_middle.BITMAP_BYTES for c in made)


def plain(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 100), (0, 0)])
def test_forms_equal_plain_cuts_and_restore(spark, documents, odd_texts, rate, spm_rate):
    texts = [
        *odd_texts, "a\nb\nc\n", "\n", "\n\n\n", "a<P>b\nc", "<<\nS>\n<M\n>P>", "one line", "x\n" * 90_000 + "end", "é\U0001f600\n" * 40,
        "same\ntext\n", "same\ntext\n",
    ]
    rows = [*enumerate(texts), (3, "a\nb\nc\n"), (3, "a\nb\nc\n"), (None, "a\nb\nc\nd")]
    found = fill_middle.fill_in_middle(documents(rows), 7, rate, spm_rate).withColumn("back", fill_middle.restored())
    got = [tuple(r) for r in found.collect()]
    want = [(*plain(i, t, rate, spm_rate), t or "") for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows(spark, documents):
    assert fill_middle.fill_in_middle(documents([])).count() == 0
