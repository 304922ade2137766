"""Line dedup: lines that many documents share stay in one of them.

Only DataFrame functions; no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import text_or_empty

# What is stripped at both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Parts into which the rows of one key are dealt when dropped keys meet their documents.
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    return _lower(F.btrim(line, F.lit(BLANKS)))


def _lower(bare: Column) -> Column:
    """``lower`` equals the lower-casing of A-Z on lines of ASCII only and is much faster there."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _key_hashes(lines: Column, min_chars: int) -> Column:
    """128 hash bits of each line's key, null for keys too short to count.

    Step by step over the whole array, since a lambda evaluates each use of an expression anew.
    """
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    long_enough = F.transform(bare, lambda x: F.when(F.length(x) >= min_chars, x))
    return F.transform(F.transform(long_enough, _lower), lambda x: F.unhex(F.md5(x.cast("binary"))))


def _lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def dropped_keys(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, drop): for each document the hashes of the keys that it loses.

    A key's hash leaves a document once, so repeats within a document never reach the
    shuffle, and every count is pre-aggregated by task. The keys found in enough documents
    meet the documents holding them dealt over ``SALTS`` parts, so that a line in a third of
    all documents is not one task's work.
    """
    hashes = F.array_distinct(F.array_compact(_key_hashes(_lines(F.col("text")), min_chars)))
    held = docs.select("doc_id", F.explode(hashes).alias("h"))
    # Rows that repeat a doc_id are one document for the count.
    once = held.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
    common = (
        once.groupBy("h").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lost = salted.join(common, ["h", "salt"]).filter(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) without the lines that other documents hold too.

    A text is split at ``\\n``. Keys (see :func:`line_key`) of at least ``min_chars`` code
    points found in at least ``min_docs`` documents lose all their lines except in the
    largest doc_id holding them; there all repeats stay. Other lines stay in order.

    Null and empty texts are one empty line and give an empty text. A null doc_id is no
    document of the count and its row keeps all lines. Rows that repeat a doc_id count
    once and lose the same keys. No rows in, no rows out; columns other than doc_id and
    text are not read, so their names cannot clash.
    """
    rows = docs.select("doc_id", "text")
    lost = dropped_keys(rows, min_chars, min_docs)
    return _without(rows, lost, min_chars).select("doc_id", "text", "n_lines", "n_dropped")


def _kept_lines(lines: Column, drop: Column, min_chars: int) -> Column:
    """The lines whose key's hash is not in ``drop``, in order; all of them where ``drop`` is null."""
    keyed = F.arrays_zip(lines.alias("line"), _key_hashes(lines, min_chars).alias("h"))
    kept = F.filter(keyed, lambda x: x["h"].isNull() | ~F.array_contains(drop, x["h"]))
    return F.when(drop.isNull(), lines).otherwise(F.transform(kept, lambda x: x["line"]))


def _without(rows: DataFrame, lost: DataFrame, min_chars: int) -> DataFrame:
    lines = _lines(F.col("text"))
    counted = rows.join(lost, "doc_id", "left").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), _kept_lines(lines, F.col("drop"), min_chars).alias("kept")
    )
    return counted.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def dedup_document_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with all its columns and the text of :func:`dedup_lines`.

    Documents that lose nothing keep their text as it is, null included. An ``n_chars``
    column, where there is one, is brought up to date for changed texts.
    """
    names = docs.columns
    lost = dropped_keys(docs.select("doc_id", "text"), min_chars, min_docs)
    mark = "drop"
    while mark in names:
        mark += "_"
    joined = docs.join(lost.withColumnRenamed("drop", mark), "doc_id", "left")
    drop = F.col(mark)
    text = F.array_join(_kept_lines(_lines(F.col("text")), drop, min_chars), "\n")
    changed = joined.withColumn("text", F.when(drop.isNull(), F.col("text")).otherwise(text))
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.when(drop.isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return changed.select(*[F.col(f"`{c}`") for c in names])
