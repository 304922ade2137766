"""Token ids in files of shuffled bit planes.

A file holds the ids of a range of documents, in ascending doc_id order. Ids are cut into
blocks of a fixed size; a block is transposed into 32 bit planes (or 4 byte planes), and each
plane is compressed with zstandard on its own: high planes of small ids are all zero and
vanish, low ones keep their own statistics.

Layout of a file (all numbers little-endian):

    record*      each ended by one line feed byte
    record 1     b"BPL1", planes per block u8 (32 or 4), ids per block u32
    block record per block: for each plane its compressed bytes, one after the other
    last record  compressed JSON index, then its length u32, then b"BPLI"

The index has the number of the file's range, for each block its offset in the file, its ids
and its planes' lengths, so a reader seeks to the blocks it needs, and for each document its
id and length, in order. Files
are written by Spark's own text writer (a record is a line; its bytes are not looked at), so
they land in any store that Spark reaches and a lost executor leaves no half file behind.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanfate.llm.common import (
    id_boundaries, in_batches, range_bucket, slices, text_or_empty, text_slices,
)
from loanfate.llm.token_words import WordEncoder, id_bytes

MAGIC, INDEX_MAGIC = b"BPL1", b"BPLI"
BLOCK_IDS = 16_384
#: Characters of texts that make about one file, and those that are encoded together.
FILE_CHARS, BATCH_CHARS = 16_000_000, 4_000_000
END = b"\n"


def split_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The block as bit planes (32) or byte planes (4), lowest first."""
    parts = [np.ascontiguousarray(ids.view(np.uint8)[k::4]) for k in range(4)]
    if planes == 4:
        return [p.tobytes() for p in parts]
    # packbits takes any byte but zero for a one.
    return [np.packbits(p & np.uint8(1 << j), bitorder="little").tobytes() for p in parts for j in range(8)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of :func:`split_planes` for a block of ``n`` ids."""
    out = np.zeros((n, 4), np.uint8)
    for k in range(4):
        if len(planes) == 4:
            out[:, k] = np.frombuffer(planes[k], np.uint8)
            continue
        part = np.zeros(n, np.uint8)
        for j, plane in enumerate(planes[8 * k:8 * k + 8]):
            if plane.strip(b"\0"):
                part |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(j)
        out[:, k] = part
    return out.view("<u4").ravel()


class PlaneWriter:
    """Turns the ids of documents into the records of one file."""

    def __init__(self, planes: int, block_ids: int, level: int, file_range: int = 0) -> None:
        self.planes, self.block_ids, self.file_range = planes, block_ids, file_range
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.n_pending = self.at = 0
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.doc_lengths: list[int] = []

    def _record(self, data: bytes) -> bytes:
        self.at += len(data) + len(END)
        return data

    def header(self) -> bytes:
        return self._record(MAGIC + struct.pack("<BI", self.planes, self.block_ids))

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.doc_lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.block_ids:
            held = np.frombuffer(b"".join(self.pending), "<u4")
            whole = len(held) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                yield self._block(held[start:start + self.block_ids])
            self.pending = [held[whole:].tobytes()]
            self.n_pending = len(held) - whole

    def _block(self, ids: np.ndarray) -> bytes:
        planes = [self.zstd.compress(p) for p in split_planes(np.ascontiguousarray(ids), self.planes)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        return self._record(b"".join(planes))

    def finish(self) -> Iterator[bytes]:
        if self.n_pending:
            yield self._block(np.frombuffer(b"".join(self.pending), "<u4"))
        index = {"range": self.file_range, "blocks": self.blocks, "doc_ids": self.doc_ids, "doc_lengths": self.doc_lengths}
        packed = self.zstd.compress(json.dumps(index).encode())
        yield self._record(packed + struct.pack("<I", len(packed)) + INDEX_MAGIC)


def read_index(content: bytes) -> tuple[int, dict]:
    """(planes per block, index) of a file's bytes."""
    if content[:4] != MAGIC or content[-5:-1] != INDEX_MAGIC:
        raise ValueError("not a bit-plane token file")
    planes, _ = struct.unpack_from("<BI", content, 4)
    (size,) = struct.unpack_from("<I", content, len(content) - 9)
    return planes, json.loads(zstandard.decompress(content[len(content) - 9 - size:len(content) - 9]))


def read_blocks(content: bytes, index: dict) -> Iterator[np.ndarray]:
    """The ids of a file, block by block."""
    zstd = zstandard.ZstdDecompressor()
    for at, n, lengths in index["blocks"]:
        planes = []
        for length in lengths:
            planes.append(zstd.decompress(content[at:at + length]))
            at += length
        yield join_planes(planes, n)


def documents_of(content: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids of the file before it, its ids) of each document; holds one document and a block."""
    _, index = read_index(content)
    blocks, held, start = read_blocks(content, index), b"", 0
    for doc_id, n in zip(index["doc_ids"], index["doc_lengths"]):
        parts = [held]
        have = len(held) // 4
        while have < n:
            block = next(blocks)
            parts.append(block.tobytes())
            have += len(block)
        joined = b"".join(parts)
        yield doc_id, start, joined[:4 * n]
        held, start = joined[4 * n:], start + n


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    files: int | None = None,
    planes: int = 32,
    block_ids: int = BLOCK_IDS,
    level: int = 3,
) -> None:
    """Encode each whole text, append ``end_id`` and write the ids to files below ``path``.

    Documents go to ``files`` ranges of doc_id of even counts, a file each; by default one for
    every :data:`FILE_CHARS` characters of the texts. Rows of one doc_id are ordered by their text's checksum,
    null before empty. A null doc_id comes first. A null or empty text has the
    end id only; a very long one may be most of a file. The ids meet the shuffle, not the texts' other columns. An empty table
    gives no file.
    """
    encoder = _encoder(tokenizer_file, end_id)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        F.col("text").isNotNull().alias("has_text"),
    )
    encoded = source.mapInArrow(encoder, "doc_id long, tie string, ids binary")
    n = files or 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // FILE_CHARS
    cuts = id_boundaries(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", n)
    ranged = encoded.withColumn("file_range", range_bucket("doc_id", cuts))
    # One partition per range: the partitioner gets the numbers 0 to n-1 as they are.
    dealt = ranged.repartitionById(len(cuts) + 1, F.col("file_range").cast("int"))
    ordered = dealt.sortWithinPartitions("file_range", F.asc_nulls_first("doc_id"), "tie")
    records = ordered.select("file_range", "doc_id", "ids").mapInArrow(
        _to_records(planes, block_ids, level), "value binary"
    )
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def _encoder(tokenizer_file: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordEncoder(tokenizer_file), id_bytes([end_id])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in text_slices(texts, BATCH_CHARS):
                some = texts[start:end]
                rows = zip(batch.column(0)[start:end].to_pylist(), some, batch.column(2)[start:end].to_pylist(), encoder.encode_all(some))
                tied = ((i, f"{int(known)}{zlib.crc32(text.encode()):08x}", ids + last) for i, text, known, ids in rows)
                yield from in_batches(tied, schema)

    return run


def _to_records(planes: int, block_ids: int, level: int):
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            writer = None
            for batch in batches:
                for file_range, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    if writer is None:
                        writer = PlaneWriter(planes, block_ids, level, file_range)
                        yield (writer.header(),)
                    elif writer.file_range != file_range:
                        raise RuntimeError("a partition holds two ranges")
                    yield from ((r,) for r in writer.add(doc_id, ids))
            if writer is not None:
                yield from ((r,) for r in writer.finish())

        # Records of a block are large; few of them make a batch.
        yield from in_batches(records(), schema, 16)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary) of all documents in the files below ``path``.

    ``start`` counts the ids of all documents before it. The files' totals are summed over one
    row per file; the ids themselves are read once more, file by file, without a shuffle.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    totals = files.select("content").mapInArrow(_totals, "file_range int, n_ids long")
    before = Window.orderBy("file_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file_range", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    documents = files.select("content").mapInArrow(
        _documents, "file_range int, doc_id long, start long, n_tokens long, ids binary"
    )
    # One row per file is broadcast; write_token_files bounds the files by a parameter.
    placed = documents.join(F.broadcast(starts), "file_range")
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_range", pa.int32()), ("n_ids", pa.int64())])
    for batch in slices(batches, 1):
        _, index = read_index(batch.column(0)[0].as_py())
        yield from in_batches([(index["range"], sum(index["doc_lengths"]))], schema)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file_range", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ])
    for batch in slices(batches, 1):
        content = batch.column(0)[0].as_py()
        file_range = read_index(content)[1]["range"]
        rows = ((file_range, doc_id, start, len(ids) // 4, ids) for doc_id, start, ids in documents_of(content))
        yield from in_batches(rows, schema, 512)
