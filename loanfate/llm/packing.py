"""Packing of token ids into fixed windows, online and in bounded space."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import in_batches, slices, stored, text_or_empty
from loanfate.llm.token_words import ByteEncoder, id_bytes

WINDOW = 2048
#: Open windows kept by each partition.
OPEN_WINDOWS = 64
#: A window's rest of at least this many ids is filled with a cut piece when the window goes out.
LEAST_CUT = 32
#: Partitions whose leftover windows are merged by one task.
MERGED_PARTITIONS = 8
#: Sequence ids of one partition; those from the second number on are for merged windows.
SEQUENCES_PER_PARTITION, MERGED_SEQUENCES = 1 << 32, 1 << 31

PIECE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_()),
])
PIECE_DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean"
)


class Packer:
    """Best-fit packing with a fixed number of open windows.

    A piece is (doc_id, start, ids, doc_tokens), its ids as little-endian 32-bit integers.
    It goes to the open window that it fills best. If none has room, the fullest window
    goes out; if that leaves a rest of ``least_cut`` ids or more, the start of the piece
    fills it, so padding stays below ``least_cut`` ids a window. A window that is full
    goes out at once.
    """

    def __init__(self, window: int, open_windows: int, least_cut: int) -> None:
        self.window, self.open_windows, self.least_cut = window, open_windows, least_cut
        self.rooms: list[tuple[int, int]] = []  # (room, number) of the open windows, ascending
        self.held: dict[int, list[tuple]] = {}
        self.number = 0

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> Iterator[list[tuple]]:
        """Put a piece into windows; yields the windows that go out, as lists of pieces."""
        at, end = 0, len(ids) // 4

        def piece(length: int) -> tuple:
            return doc_id, start + at, ids[4 * at:4 * (at + length)], doc_tokens

        while at < end:
            need = end - at
            if need >= self.window:
                yield [piece(self.window)]
                at += self.window
                continue
            i = bisect_left(self.rooms, (need, -1))
            if i < len(self.rooms):
                room, number = self.rooms.pop(i)
                self.held[number].append(piece(need))
                if room == need:
                    yield self.held.pop(number)
                else:
                    insort(self.rooms, (room - need, number))
                return
            if len(self.rooms) < self.open_windows:
                self.held[self.number] = [piece(need)]
                insort(self.rooms, (self.window - need, self.number))
                self.number += 1
                return
            room, number = self.rooms.pop(0)
            if room >= self.least_cut:
                self.held[number].append(piece(room))
                at += room
            yield self.held.pop(number)

    def rest(self) -> Iterator[list[tuple]]:
        """The windows still open, fullest first."""
        for _, number in self.rooms:
            yield self.held.pop(number)
        self.rooms = []


def _rows(pieces: list[tuple], sequence_id: int, leftover: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, doc_tokens in pieces:
        length = len(ids) // 4
        yield doc_id, start, length, ids, doc_tokens, sequence_id, offset, leftover
        offset += length


def pack_ids(
    tokens: DataFrame,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """Pack (doc_id, ids binary) into windows: one row per piece, in the columns of PIECE_DDL.

    Each partition packs its documents as they come (:class:`Packer`). Its open windows at
    the end are leftovers: at most ``open_windows`` per partition, whatever the partition's
    size. They are merged in a second round, by ``merged_partitions`` partitions at a time,
    so no task gets more than ``open_windows * merged_partitions`` windows. The first
    round is written to the shared folder, since its windows depend on the order in which
    rows came and must not be computed twice.

    Rows without ids have no piece. A null doc_id is kept. Repeated rows are packed each.
    """
    first = tokens.select("doc_id", "ids").mapInArrow(_first_round(window, open_windows, least_cut), PIECE_DDL)
    return merge_leftovers(stored(first, "packed"), window, open_windows, least_cut, merged_partitions)


def merge_leftovers(
    packed: DataFrame,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """Windows that went out as they are, and the leftover windows packed again by groups of partitions."""
    whole = packed.filter(~F.col("leftover"))
    group = F.floor(F.col("sequence_id") / F.lit(SEQUENCES_PER_PARTITION * merged_partitions)).cast("long")
    rest = (
        packed.filter("leftover").withColumn("merge_group", group)
        .groupBy("merge_group").applyInArrow(_merge_round(window, open_windows, least_cut), PIECE_DDL)
    )
    return whole.unionByName(rest)


def _first_round(window: int, open_windows: int, least_cut: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        packer, made = Packer(window, open_windows, least_cut), 0

        def pieces() -> Iterator[tuple]:
            nonlocal made
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for out in packer.add(doc_id, 0, ids or b"", len(ids or b"") // 4):
                        yield from _rows(out, base + made, False)
                        made += 1
            for out in packer.rest():
                yield from _rows(out, base + made, True)
                made += 1

        yield from in_batches(pieces(), PIECE_SCHEMA)

    return run


def _merge_round(window: int, open_windows: int, least_cut: int):
    def run(table: pa.Table) -> pa.Table:
        """Whole leftover windows are the pieces here; their documents' pieces stay together unless cut.

        If that takes more windows than before, which a smaller number of open ones can, the windows
        stay as they were. Sequence ids of merged windows are the first partition's reserved ones.
        """
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        columns = ("doc_id", "start", "ids", "doc_tokens", "sequence_id")
        rows = list(zip(*(table.column(c).to_pylist() for c in columns)))
        packer, made = Packer(window, open_windows, least_cut), []
        # Longest first: the small ones then fill what the large ones leave.
        for doc_id, start, ids, doc_tokens, _ in sorted(rows, key=lambda r: (-len(r[2]), r[4], r[1])):
            made += packer.add(doc_id, start, ids, doc_tokens)
        made += packer.rest()
        before: dict[int, list[tuple]] = {}
        for *piece, sequence_id in rows:
            before.setdefault(sequence_id, []).append(tuple(piece))
        first = rows[0][4] // SEQUENCES_PER_PARTITION * SEQUENCES_PER_PARTITION + MERGED_SEQUENCES
        merged = dict(enumerate(made, first)) if len(made) <= len(before) else before
        out = (row for sequence_id, pieces in merged.items() for row in _rows(pieces, sequence_id, False))
        return pa.Table.from_batches(list(in_batches(out, PIECE_SCHEMA)), schema=PIECE_SCHEMA)

    return run


def encode_for_packing(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text, then ``end_id``; a null text is empty."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ByteEncoder(tokenizer_file), id_bytes([end_id])
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch in slices(batches, 1024):
            texts = batch.column(1).to_pylist()
            rows = zip(batch.column(0).to_pylist(), texts)
            yield from in_batches(((i, encoder.encode(text) + last) for i, text in rows), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, **options) -> DataFrame:
    """Encode whole texts and pack them; see :func:`encode_for_packing` and :func:`pack_ids`.

    Empty and null texts give a piece of one id, the end. Very long texts fill windows of
    their own and their rest is packed. No rows in, no rows out. Columns other than doc_id
    and text are not read.
    """
    return pack_ids(encode_for_packing(docs, tokenizer_file, end_id), **options)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned CRC-32 of their bytes, with Spark's own function."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
