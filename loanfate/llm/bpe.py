"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import in_batches, slices, text_or_empty

#: Longer texts are cut at safe boundaries, so that no call of the library holds more than about this.
PIECE_CHARS = 65_536

#: Longer runs of white space are encoded by themselves: the split pattern looks back over a run one step a character.
LONG_BLANK = 10_000

#: Between a character that is no white space and one white space before a visible character a match of
#: the split pattern always ends: its white space alternatives start there anew.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def rank_encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once in each Python worker; without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut only where no match can span.

    The cut is before a single space between two visible characters: in a pattern whose
    matches take a space at their start only, no match holds such a space further in.
    Where there is no such place the piece goes on to the next one, or to the end.
    """
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=4)
def _blank_run(least: int) -> regex.Pattern:
    return regex.compile(rf"\p{{White_Space}}{{{least},}}")


def encode(encoding: tiktoken.Encoding, text: str, most: int = PIECE_CHARS, long_blank: int = LONG_BLANK) -> list[int]:
    """The ids of a whole text of any length, as the library gives them.

    A run of white space is one match of the split pattern, all but its last character where
    something visible follows. Runs of ``long_blank`` characters or more, on which the library's
    pattern runs out of stack, are found by a linear scan and merged as the single piece they are.
    """
    ids: list[int] = []
    start = 0
    if len(text) >= long_blank:
        for blank in _blank_run(long_blank).finditer(text):
            end = blank.end() if blank.end() == len(text) else blank.end() - 1
            ids += _encode_pieces(encoding, text[start:blank.start()], most)
            ids += encoding._encode_single_piece(text[blank.start():end])
            start = end
    return ids + _encode_pieces(encoding, text[start:], most)


def _encode_pieces(encoding: tiktoken.Encoding, text: str, most: int) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text, most):
        ids += encoding.encode_ordinary(piece)
    return ids


def decode(encoding: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids, which need not be valid UTF-8."""
    return encoding.decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, ids array<int>): each whole text encoded, each match of the pattern separately.

    A null or empty text has no ids. Rows stay as they are, repeats included; a null
    doc_id stays null. Other columns are not read, so their names cannot clash. A long
    text is encoded piece by piece, which gives the same ids. No rows give no rows. No shuffle.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(rank_file, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in slices(batches, 256):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield from in_batches(((i, encode(encoding, text, piece_chars)) for i, text in rows), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, content binary): the bytes of ``ids``. Null ids give no bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(rank_file, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])
        for batch in slices(batches, 256):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield from in_batches(((i, decode(encoding, ids or [])) for i, ids in rows), schema)

    source = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return source.mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and then decoding each text.

    Both steps run in the same task, since ids need not leave it for a digest. Cases as in
    :func:`encode_documents`.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(rank_file, pattern)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
        ])

        def row(doc_id: int | None, text: str) -> tuple:
            ids = encode(encoding, text, piece_chars)
            listed = ",".join(map(str, ids)).encode()
            back = decode(encoding, ids)
            return doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest()

        for batch in slices(batches, 1024):
            yield from in_batches(map(row, batch.column(0).to_pylist(), batch.column(1).to_pylist()), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
