"""Top-k products against all products."""

import math
import random

import pytest

from loanfate.llm import topk


def plain(queries, vectors, k):
    want = set()
    for i, q in queries:
        scores = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q)})
        want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)}
    return want


def random_vectors(n, dims, seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scale = rng.choice([1, 1, 1, 8])
        rows.append((i, [float(rng.randint(-20, 20) * scale) for _ in range(dims)]))
    same = rows[0][1]
    return rows + [(n + i, same) for i in range(hot)]


@pytest.mark.parametrize("k, block, buckets", [(5, 40, 4), (1, 1000, 16), (3, 25, 1), (500, 64, 4)])
def test_equals_all_products(spark, k, block, buckets):
    rows = random_vectors(250, 6, k, hot=120) + [(1000, [1.0, 2.0]), (1050, [3.0, 4.0]), (1100, [0.0] * 6)]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4), "vec_id", "v")
    found = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k, block, buckets)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain([r for r in rows if r[0] % 50 == 0], rows, k)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, None, "a"), (3, [1.0, None], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"),
            (None, [1.0, 1.0], "a"), (6, [], "a"), (7, [0.5, 0.5], None), (8, [-inf, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm string")
    kept = topk.usable(frame, "vec_id", "embedding")
    assert sorted(r.vec_id for r in kept.collect()) == [1, 7]
    found = topk.top_k(kept, kept, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(1, 1, 7, 1.5), (7, 1, 1, 1.5)]
    assert topk.top_k(kept.limit(0), kept, 5).count() == topk.top_k(kept, kept.limit(0), 5).count() == 0


def test_pruning_keeps_every_vector_that_reaches_the_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.normal(size=(60, 5)) * rng.choice([1, 3], (60, 1))
        norm = np.linalg.norm(v, axis=1)
        bucket = topk.Bucket(np.arange(60), v, norm)
        q = rng.normal(size=5)
        scores = bucket.v @ q
        bound = float(np.sort(scores)[-rng.integers(1, 20)])
        chosen = np.zeros(60, bool)
        chosen[bucket.candidates(q, float(math.sqrt(q @ q)), bound)] = True
        assert chosen[scores >= bound].all()
