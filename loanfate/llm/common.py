"""Helpers shared by the corpus operators: scratch tables, ordered buckets, output batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a statement's shuffle files at its end.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Python gathers before it hands a batch back.
ROWS_PER_BATCH = 2048


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder. Where it is unset, as in tests, a folder in
    the session's warehouse is taken; both are seen by the driver and every executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of statements made and run inside go as they end, where the session can do that."""
    if not spark.conf.isModifiable(_FREE_SHUFFLES):
        yield
        return
    # With a default of its own, get() would not give that of a setting nobody has set.
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at files that survive a lost executor, and what is read twice is
    computed once. Shuffle files of the write go when it ends, where the session can do that.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing will read any more; other tables have none."""
    for df in tables:
        if name := vars(df).get("_stored_at"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Spark hand Python at most so many rows at a time.

    Its default is 10,000, which for whole texts is a great deal of memory in the executor and
    once more in the Python worker. The setting is the session's and changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle that follows a scan: the session's own number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_boundaries(ids: DataFrame, column: str, buckets: int, accuracy: int = 20_000) -> list[int]:
    """At most ``buckets`` ascending values of an integer column that cut it into even ranges.

    One aggregation over the column; the driver gets no more than ``buckets`` numbers,
    whatever the input's size. The values only spread work: any list gives the same results.
    """
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    found = ids.agg(F.percentile_approx(column, shares, accuracy)).first()[0]
    return sorted(set(found or []))


def range_bucket(column: str | Column, boundaries: list[int]) -> Column:
    """Number of boundaries at or below the value: 0 to ``len(boundaries)``; nulls come first.

    A balanced tree of comparisons, so a row meets about log2 of them.
    """
    value = F.col(column) if isinstance(column, str) else column

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(boundaries[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(boundaries)))


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, for bounded work memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most`` characters each; every range has a text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
