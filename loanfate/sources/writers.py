"""Writers, and staging of tables that later steps read several times."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanfate.sources.archives import LoanArchives

#: Spark's setting that removes a statement's shuffle files at its end.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_result(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Write a result with a header from the executors.

    ``single_file`` is for small summary tables. The shuffle it adds keeps the work before
    it parallel; only the write of the final rows is one task.
    """
    out = df.repartition(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_loan_archives(df: DataFrame, path: str, preamble: str | None = None, footer: str | None = None) -> None:
    """Write a table as ZIP archives of one CSV file each, one for every partition that has rows.

    ``preamble`` is a line before the header and ``footer`` one after the rows, as published
    files have them. Archives appear in the folder when all of them are written. All columns
    are written as text.
    """
    df.sparkSession.dataSource.register(LoanArchives)
    marks = {k: v for k, v in (("preamble", preamble), ("footer", footer)) if v is not None}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.format("loan_archives").options(**marks).mode("append").save(path)


def write_facts(loans: DataFrame, path: str) -> None:
    """Write cleaned loans as Parquet, one directory per issue year.

    The rebalance hint lets adaptive execution split a big year over many files and join
    small ones, so neither a hot year nor thousands of tiny files result.
    """
    years = loans.withColumn("issue_year", F.year("issue_d"))
    years.hint("rebalance", "issue_year").write.mode("overwrite").partitionBy("issue_year").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned loans written by :func:`write_facts`; filters reach the files and directories."""
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, where ``spark.checkpoint.dir`` or the context names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Statements made and run inside free their shuffle files as they end, where the session can do that.

    Else the files stay until the driver happens to collect its garbage. For statements that run once.
    """
    if not spark.conf.isModifiable(_FREE_SHUFFLES):
        yield
        return
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Used where several fits read the same features: the lineage ends at files every
    executor can reach, and each later read takes only the columns it needs. A session
    that names no shared folder keeps the table in executor storage, which lineage can
    rebuild; :func:`release` gives it free.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = _new_path(folder)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Free the executor storage of a staged table that nothing reads any more; files stay."""
    df.unpersist()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, or below the session's warehouse, which is shared too."""
    return _new_path(shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir"))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a :func:`scratch_path` that nothing will read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _new_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/loanfate-{uuid.uuid4().hex}"
