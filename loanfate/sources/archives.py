"""Loan files as they are published: ZIP archives of CSV members, read and written in place.

Spark's CSV reader opens gzip but not ZIP. Here each member of each archive is a partition, which a
task inflates as a stream, so neither an archive nor a member is held whole. The file system is
reached through Arrow and may be local, HDFS or an object store.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StringType, StructType

#: Bytes of a member that are parsed at a time.
BLOCK_BYTES = 4 << 20
#: Lines among which the header is looked for: the first, or the second after a line of junk.
HEADER_LINES = 2


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archive_files(path: str) -> list[str]:
    """Archives below a folder, in order of their names, or the path itself if it is an archive."""
    system, inner = _located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path.rstrip("/")
    shown = [f.path[len(inner.rstrip("/")):] for f in found if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith((".", "_"))]
    return sorted(prefix + name for name in shown)


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = _located(path)
    return zipfile.ZipFile(system.open_input_file(inner))


@dataclass
class Member(InputPartition):
    """One CSV member of an archive."""

    archive: str
    name: str


class ArchiveReader(DataSourceReader):
    """Reads the schema's columns of every CSV member, each by its own header."""

    def __init__(self, schema: StructType, options: dict) -> None:
        if any(not isinstance(f.dataType, StringType) for f in schema):
            raise ValueError("archives are read as text; cast afterwards")
        self.columns = schema.fieldNames()
        self.key = options.get("headerColumn", "loan_amnt")
        self.paths = [p for p in options["path"].split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        """The members by the archives' own directories, which are a few bytes at their ends."""
        members = []
        for path in self.paths:
            for archive in archive_files(path):
                with _opened(archive) as held:
                    members += [Member(archive, i.filename) for i in held.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv")]
        # Spark asks for at least one partition.
        return members or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        if not partition.archive:
            return
        with _opened(partition.archive) as held:
            names, skipped = self._header(held, partition)
            with held.open(partition.name) as stream:
                reader = pacsv.open_csv(
                    stream,
                    read_options=pacsv.ReadOptions(column_names=names, skip_rows=skipped, block_size=BLOCK_BYTES, use_threads=False),
                    parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=_odd_row),
                    convert_options=pacsv.ConvertOptions(
                        include_columns=self.columns, include_missing_columns=True, column_types={c: pa.string() for c in {*names, *self.columns}},
                        null_values=[""], strings_can_be_null=True,  # quoted blanks too, as in plain files
                    ),
                )
                for batch in reader:
                    for start in range(0, batch.num_rows, 4096):
                        yield batch.slice(start, 4096).cast(schema)

    def _header(self, held: zipfile.ZipFile, member: Member) -> tuple[list[str], int]:
        """Column names of a member, and the lines up to and with its header."""
        with held.open(member.name) as stream, io.TextIOWrapper(stream, "utf-8", newline="") as text:
            for line in range(1, HEADER_LINES + 1):
                names = [n.strip().lstrip("﻿") for n in next(csv.reader([text.readline()]), [])]
                if self.key in names:
                    return names, line
        raise ValueError(f"no header with {self.key} in the first {HEADER_LINES} lines of {member.name} in {member.archive}")


def _odd_row(row: pacsv.InvalidRow) -> str:
    """A line of a single field is a footer; any other line of the wrong length is an error."""
    return "skip" if row.actual_columns == 1 else "error"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the unfinished file and its final name, none for no rows."""

    unfinished: str | None
    final: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """Writes every partition as an archive of one CSV member; archives appear when all tasks are done."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.path = schema.fieldNames(), options["path"].rstrip("/")
        self.preamble, self.footer = options.get("preamble"), options.get("footer")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}"
        unfinished = f"{self.path}/.{name}-{context.taskAttemptId()}.csv.zip"
        system, inner = _located(unfinished)
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None, None)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
            with held.open(f"{name}.csv", "w", force_zip64=True) as stream:
                if self.preamble:
                    stream.write(f"{self.preamble}\n".encode())
                options = pacsv.WriteOptions(include_header=True, quoting_style="needed")
                with pacsv.CSVWriter(pa.PythonFile(stream, "w"), first.schema, write_options=options) as rows:
                    rows.write_batch(first)
                    for batch in iterator:
                        rows.write_batch(batch)
                if self.footer:
                    stream.write(f"{self.footer}\n".encode())
        return Written(unfinished, f"{self.path}/{name}.csv.zip")

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.unfinished:
                system, inner = _located(m.unfinished)
                system.move(inner, _located(m.final)[1])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.unfinished:
                system, inner = _located(m.unfinished)
                system.delete_file(inner)


class LoanArchives(DataSource):
    """The format ``loan_archives``: a folder of ZIP archives of CSV files, or one archive.

    Reading needs a schema of text columns; columns that a member lacks are null. ``headerColumn``
    names a column by which the header is known. Writing takes a ``preamble`` and a ``footer``.
    """

    @classmethod
    def name(cls) -> str:
        return "loan_archives"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(schema, dict(self.options))
