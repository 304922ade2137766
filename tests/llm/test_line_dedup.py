"""Line dedup against plain counting."""

import random
from collections import defaultdict

import pytest

from loanfate.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(plain_key(line)) >= min_chars:
                holders[plain_key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[plain_key(x)]) < min_docs or max(holders[plain_key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    shared = [f"A Shared Line number {k} that is long enough to count, É ß {k}" for k in range(6)]
    shared += [x.upper() for x in shared] + ["short shared line", "", "x" * 39, "x" * 40, "é" * 40, "İ" * 41, "日本" * 30]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            line = rng.choice(shared) if rng.random() < 0.6 else f"own line {rng.random()} of document {i} " + "y" * 30
            lines.append(rng.choice(["", " ", "\t", "\x0b"]) + line + rng.choice(["", "\r", "  ", " ", "\x1c"]))
        rows.append((rng.randrange(n) if rng.random() < 0.1 else i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("min_docs", [2, 5])
def test_equals_plain_counting(documents, seed, min_docs):
    rows = random_rows(120, seed)
    assert got(line_dedup.dedup_lines(documents(rows), min_docs=min_docs)) == plain(rows, min_docs=min_docs)


def test_odd_rows(documents, odd_texts):
    line = "the same long line in every one of these many documents"
    rows = [*enumerate(odd_texts), *((100 + k, f"{line}\n{line.upper()}\nown {k}") for k in range(7)), (None, line), (None, None),
            (103, f"{line}\nsecond row of one id"), (106, line)]
    assert got(line_dedup.dedup_lines(documents(rows))) == plain(rows)
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_whole_rows_keep_their_columns(documents):
    line = "the same long line in every one of these many documents"
    docs = documents([*((k, f"{line}\nown {k}") for k in range(6)), (9, None), (None, line)])
    out = line_dedup.dedup_document_lines(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {**{k: (f"own {k}", 5) for k in range(5)}, 5: (f"{line}\nown 5", len(line) + 6), 9: (None, None), None: (line, len(line))}


def test_no_python_on_the_main_path(documents):
    plan = line_dedup.dedup_lines(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
