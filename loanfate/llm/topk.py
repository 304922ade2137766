"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length. A query's current k-th score is a bound:
divided by the query's length and a bucket's greatest length it is the cosine that a vector of
that bucket must reach (its local threshold). Above one, the bucket is left out before any
vector of it meets the query. In the others the threshold chooses how vectors are pruned: a
high one prunes by coordinates (a vector close to the query in direction must lie in a narrow
range on the query's strongest coordinates), a low one by length alone. What stays is verified by
its product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import id_boundaries, range_bucket, stored

#: Buckets of the vectors' lengths; each is split into blocks for work in parallel.
BUCKETS = 16
#: Vectors of a block, and queries of a block.
BLOCK = 4096
#: Local threshold from which coordinates prune better than length.
COORDINATE_FROM = 0.35
#: Strongest coordinates of a query that are looked at.
COORDINATES = 3
#: Slack for rounding in the bounds; products are exact.
SLACK = 1e-9

RESULT_DDL = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dims, norm) of the rows that take part.

    Rows whose id or vector is null, or whose vector holds a null, infinite or NaN component,
    take no part; nor do vectors without components. Rows that repeat an id and vector are one.
    """
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    kept = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite).dropDuplicates()
    return kept.select("vec_id", "v", F.size("v").alias("dims"), F.sqrt(square).alias("norm"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` greatest inner products.

    Both sides have the columns of :func:`usable`. A query never meets a vector of its own
    id, nor one of other dimensions. Fewer vectors give fewer rows; ties go to the smaller
    vec_id. Products are summed in double precision and exact for integers below 2^53.

    Round one takes, of each dimension, the blocks of the greatest lengths and gives every
    query a first bound; round two takes all other blocks, except where the bound rules a
    query out. Work is dealt by (block of vectors, block of queries), so neither a frequent
    vector, nor many vectors of one length, nor many queries land in one task. A task gives
    at most ``k`` rows per query.
    """
    vectors = stored(_in_blocks(vectors, block, buckets), "vectors")
    blocks = vectors.groupBy("dims", "bucket", "part").agg(F.max("norm").alias("top_norm"), F.count("*").alias("n"))
    # One row for each block of thousands of vectors.
    blocks = stored(blocks, "blocks")
    firsts = blocks.groupBy("dims").agg(F.max("bucket").alias("bucket"))
    asked = stored(_query_blocks(queries, block), "queries")

    first_blocks = blocks.join(firsts, ["dims", "bucket"], "left_semi")
    found = stored(_score(asked.withColumn("bound", F.lit(-math.inf)), vectors, first_blocks, k), "top-1")
    bounds = found.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), False), k)).alias("bound")
    ) if k else found
    # Only k rows per query and block of the first round are gathered here.
    known = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
    later = blocks.join(firsts, ["dims", "bucket"], "left_anti")
    return _ranked(found.unionByName(_score(known, vectors, later, k)), k)


def _in_blocks(vectors: DataFrame, block: int, buckets: int) -> DataFrame:
    """Add ``bucket`` by length, ascending, and ``part`` within it, so that a part has about ``block`` vectors."""
    # Lengths as integers of their bits keep their order and suit integer boundaries.
    key = F.floor(F.col("norm") * F.lit(2.0 ** 20)).cast("long")
    keyed = vectors.withColumn("key", key)
    cuts = id_boundaries(keyed, "key", buckets)
    placed = keyed.withColumn("bucket", range_bucket("key", cuts)).drop("key")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = sizes.select("bucket", F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("parts"))
    # One row for each bucket.
    salted = placed.join(F.broadcast(parts), "bucket")
    return salted.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")


def _query_blocks(queries: DataFrame, block: int) -> DataFrame:
    parts = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    return queries.select(F.col("vec_id").alias("query_id"), "v", "dims", "norm", part.alias("q_part"))


def _score(asked: DataFrame, vectors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each (query, block) that the query's bound does not rule out."""
    key = ["dims", "bucket", "part", "q_part"]
    reach = F.col("bound") <= F.col("norm") * F.col("top_norm") * (1 + SLACK) + SLACK
    q = asked.join(blocks.select("dims", "bucket", "part", "top_norm"), "dims").filter(reach)
    q = q.select(*key, "query_id", "v", "norm", "bound")
    # A block of vectors goes where a block of queries still asks for it.
    wanted = q.select(*[F.col(x).alias(f"w_{x}") for x in key]).distinct()
    met = [vectors[x] == wanted[f"w_{x}"] for x in key[:3]]
    c = vectors.join(wanted, met).select(*[f"w_{x}" for x in key], "vec_id", "v", "norm")

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        return _search(queries, block, k)

    return q.groupBy(*key).cogroup(c.groupBy(*[f"w_{x}" for x in key])).applyInArrow(run, RESULT_DDL)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _search(queries: pa.Table, block: pa.Table, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and block.num_rows and k:
        bucket = Bucket(block.column("vec_id").to_numpy(), _matrix(block), block.column("norm").to_numpy())
        rows = zip(queries.column("query_id").to_pylist(), _matrix(queries), queries.column("norm").to_pylist(),
                   queries.column("bound").to_pylist())
        for query_id, q, norm, bound in rows:
            ids, scores = bucket.best(query_id, q, norm, bound, k)
            out.append((np.full(len(ids), query_id), ids, scores))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in ("i8", "i8", "f8")]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))


class Bucket:
    """A block of vectors by descending length, and sorted lists of their directions' coordinates."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        order = np.lexsort((ids, -norm))
        self.ids, self.v, self.norm = ids[order], np.ascontiguousarray(v[order]), norm[order]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of coordinate ``f`` of the unit vectors, ascending, and whose they are."""
        if f not in self.lists:
            unit = np.divide(self.v[:, f], self.norm, out=np.zeros(len(self.norm)), where=self.norm > 0)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = unit[order], order
        return self.lists[f]

    def candidates(self, q: np.ndarray, norm: float, bound: float) -> np.ndarray | slice:
        """Vectors that may reach ``bound``, by the cheaper of the two prunings."""
        if norm <= 0 or bound <= 0:
            return slice(None)
        threshold = bound / (norm * self.norm[0]) if self.norm[0] > 0 else math.inf
        if threshold > 1 + SLACK:
            return slice(0)
        # A vector shorter than this fails even in the query's own direction.
        reach = slice(0, int(np.searchsorted(-self.norm, -(bound / norm) * (1 - SLACK), side="right")))
        if threshold < COORDINATE_FROM:
            return reach
        unit = q / norm
        best: np.ndarray | slice = reach
        for f in np.argsort(-np.abs(unit))[:COORDINATES]:
            spread = math.sqrt(max(0.0, (1 - threshold ** 2) * (1 - unit[f] ** 2)))
            middle = unit[f] * threshold
            low = -1.0 if unit[f] <= -threshold else middle - spread
            high = 1.0 if unit[f] >= threshold else middle + spread
            values, who = self.coordinate(int(f))
            a, b = np.searchsorted(values, low - 1e-7), np.searchsorted(values, high + 1e-7, side="right")
            if b - a < (len(best) if isinstance(best, np.ndarray) else best.stop):
                best = who[a:b]
        return best

    def best(self, query_id: int, q: np.ndarray, norm: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and products of the ``k`` best vectors that reach ``bound``, the query's own left out."""
        chosen = self.candidates(q, norm, bound)
        ids = self.ids[chosen]
        scores = self.v[chosen] @ q
        kept = (ids != query_id) & (scores >= bound)
        ids, scores = ids[kept], scores[kept]
        if len(ids) > k:
            # All that tie with the k-th stay for the choice by id.
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            kept = scores >= least
            ids, scores = ids[kept], scores[kept]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Ranks of the best ``k``: an aggregation of at most ``k`` rows per query and block."""
    row = F.struct((-F.col("score")).alias("order"), F.col("vec_id"), F.col("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(row)), 1, max(1, k)).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "row"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.score")
