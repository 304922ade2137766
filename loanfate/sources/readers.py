"""CSV readers. No reader infers types, so none starts a job over the data; headers are one line each."""

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanfate.schema import CROSSWALK_SCHEMA, LOAN_COLUMNS, ZIP_BASE_SCHEMA
from loanfate.sources.archives import LoanArchives


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _header_after_preamble(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file whose first line is junk: the header is the second line."""
    for row in spark.read.text(path).take(2):
        names = next(csv.reader([row.value]), [])
        if "loan_amnt" in names:
            return names
    raise ValueError(f"no loan header in the first two lines of {path}")


def read_loans(
    spark: SparkSession,
    paths,
    skip_preamble: bool = False,
    columns: list[str] | None = None,
    multi_line: bool = False,
    escape: str = '"',
    archives: bool = False,
) -> DataFrame:
    """Read one or more loan CSV files as one table of raw text columns, matched by name.

    ``archives`` reads ZIP archives, or folders of them, a task for each CSV member; see
    :func:`read_loan_archives`. Only the paths and ``columns`` matter then.

    ``columns`` gives the files' column names in order; all paths are then one scan, which
    is the way to read a large directory. Without it the header of every path is read, and
    paths with the same header are one scan. A file whose header differs from the columns
    it is read with raises an error, since its values would be taken for others.

    ``skip_preamble`` is for files whose header is line 2. The preamble, header and footer
    lines have no numeric ``loan_amnt`` and are filtered out.

    Quotes inside a quoted description are doubled in these files; ``escape`` names the mark.
    ``multi_line`` reads descriptions with line breaks, at the price that a file is one task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if archives:
        return read_loan_archives(spark, paths, columns)
    options = {"mode": "PERMISSIVE", "multiLine": multi_line, "escape": escape}

    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        if columns is not None:
            names = columns
        elif skip_preamble:
            names = _header_after_preamble(spark, path)
        else:
            names = spark.read.options(header=True, **options).csv(path).columns
        by_header.setdefault(tuple(names), []).append(path)

    frames = []
    for names, alike in by_header.items():
        reader = spark.read.options(header=not skip_preamble, enforceSchema=False, **options).schema(_text_schema(names))
        frames.append(_loan_rows(reader.csv(alike), skip_preamble))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_loan_archives(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    """Loans in ZIP archives of CSV files as a table of raw text columns, matched by each member's header.

    Every CSV member of an archive is one partition and is inflated as a stream. Its header is
    line 1, or line 2 after a line of junk; footers of one field are left out, and so are lines
    without a numeric ``loan_amnt``. Other lines of the wrong length raise an error. Fields may
    hold line breaks in quotes. ``columns`` are read, :data:`LOAN_COLUMNS` and ``id`` if not given;
    those that a file lacks are null. A folder without archives gives no rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = list(dict.fromkeys([*(columns or ["id", *LOAN_COLUMNS]), "loan_amnt"]))
    spark.dataSource.register(LoanArchives)
    raw = spark.read.format("loan_archives").schema(_text_schema(names)).load("\n".join(paths))
    return _loan_rows(raw.filter(F.col("loan_amnt").try_cast("double").isNotNull()), junk_lines=False)


# Columns whose values are never the name of a column.
_TELLTALE = ["loan_amnt", "grade", "loan_status", "int_rate", "issue_d"]


def _loan_rows(raw: DataFrame, junk_lines: bool) -> DataFrame:
    present = [c for c in LOAN_COLUMNS if c in raw.columns and c != "loan_id"]
    # The public files leave the id blank. The row's own text then identifies the loan, so
    # that draws by loan stay repeatable; it is computed only where the id is used.
    loan_id = F.md5(F.concat_ws("|", *present))
    for given in ("id", "loan_id"):
        if given in raw.columns:
            loan_id = F.coalesce(F.nullif(F.trim(given), F.lit("")), loan_id)
    if junk_lines:
        raw = raw.filter(_is_loan(raw.columns))
    return raw.select(loan_id.alias("loan_id"), *present)


def _is_loan(names: list[str]):
    """Whether a line is a loan; a header in another order than the names raises an error."""
    told = [c for c in _TELLTALE if c in names]
    header = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(names), F.lit(False)) for c in told])
    in_order = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(c)) for c in told])
    wrong = F.raise_error(F.lit("a file's header differs from the columns it is read with")).cast("boolean")
    amount = F.col("loan_amnt").try_cast("double").isNotNull()
    return F.when(~header, amount).otherwise(F.when(in_order, F.lit(False)).otherwise(wrong))


def _by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns by the names in the files' header, in any order; every file's header is checked."""
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.read.schema(_text_schema(names)).options(header=True, enforceSchema=False).csv(path)
    return raw.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_zip_base(spark: SparkSession, path: str) -> DataFrame:
    """ZIP to county lines, all text."""
    return _by_header(spark, path, ZIP_BASE_SCHEMA)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Crosswalk weights; ZIPxx in lower case as in the loan data, FIPS codes as text."""
    return _by_header(spark, path, CROSSWALK_SCHEMA).withColumn("ZIPxx", F.lower("ZIPxx"))


def read_result(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Read chosen columns of a result CSV by name, cast to the given types."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select([F.col(c).try_cast(t).alias(c) for c, t in columns.items()])
