"""Fill-in-the-middle forms of documents, cut at the ends of units that a roaring-style set holds.

The places where a text's units end are a set of integers. As in a roaring bitmap it is cut by the
high 16 bits into containers, each in the smallest of three forms: an array of the low 16 bits, a
bitmap of 65,536 bits, or runs. Cumulative cardinalities say which container holds the k-th member,
and a select within the container gives its place, so both cuts of a text cost two searches
whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import in_batches, slices, text_or_empty

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a container, and the bytes of its bitmap.
LOW_BITS = 16
BITMAP_BYTES = (1 << LOW_BITS) // 8

LINE_END = 10


class ArrayContainer:
    """The members' low bits, ascending."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])

    def nbytes(self) -> int:
        return self.low.nbytes


class BitmapContainer:
    """One bit for each of the 65,536 values, and the number of members before each 64 of them."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left, rest = int(self.words[word]), k - int(self.before[word])
        for _ in range(rest):
            left &= left - 1
        return word * 64 + (left & -left).bit_length() - 1

    def nbytes(self) -> int:
        return self.words.nbytes


class RunContainer:
    """Starts of runs of consecutive values, and the number of members before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = starts
        self.before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])

    def nbytes(self) -> int:
        return 4 * len(self.starts)


def container(low: np.ndarray):
    """The smallest container of ascending different low bits (uint16)."""
    first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
    if 4 * len(first) < min(low.nbytes, BITMAP_BYTES):
        return RunContainer(low[first], np.diff(np.append(first, len(low))))
    return ArrayContainer(low) if low.nbytes <= BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """A set of ascending different non-negative integers with :meth:`select`."""

    def __init__(self, values: np.ndarray) -> None:
        high = values >> LOW_BITS
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(starts[1:], len(values))
        self.keys = [int(high[s]) for s in starts]
        self.containers = [container((values[s:e] & 0xFFFF).astype(np.uint16)) for s, e in zip(starts, ends)]
        self.before = np.append(0, ends)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest member, k from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return (self.keys[i] << LOW_BITS) + self.containers[i].select(k - int(self.before[i]))


def line_boundaries(text: str) -> BoundarySet:
    """Code points before the end of each line; a last line without a line end counts, an empty one doesn't."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == LINE_END) + 1
    if len(codes) and codes[-1] != LINE_END:
        ends = np.append(ends, len(codes))
    return BoundarySet(ends.astype(np.int64))


def draws(seed: int = 7, doc_id: str | Column = "doc_id") -> list[Column]:
    """Four unsigned 32-bit draws of a document: the start of the SHA-256 of ``seed:doc_id``.

    A null id counts as an empty one.
    """
    held = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(held.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform_text(text: str, h: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """(units, form, prefix code points, middle code points, output) of one text."""
    ends = line_boundaries(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row's whole text.

    The text is cut into ``n`` lines; the cuts, whether a text is transformed (``rate`` percent
    are) and its form (``spm_rate`` percent have the suffix first) are drawn from the doc_id, so
    a task that runs again makes the same output. One pass without a shuffle.

    Null texts count as empty; empty texts and those that hold a mark stay plain, with null
    counts. Very long texts are cut like others: their set has more containers. A null doc_id is
    kept and draws as an empty one. Repeated rows, and rows that share a doc_id, are transformed
    each; equal draws cut at the same place and leave an empty middle. No rows give no rows.
    Columns other than doc_id and text are not read.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()), ("output", pa.string()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            ids, texts, *h = (batch.column(i).to_pylist() for i in range(6))
            rows = ((i, *transform_text(text, drawn, rate, spm_rate)) for i, text, *drawn in zip(ids, texts, *h))
            yield from in_batches(rows, schema)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        *[h.alias(f"h{k}") for k, h in enumerate(draws(seed))],
    )
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The exact text, rebuilt from a form's output alone.

    A transformed text holds no mark of its own, and none can arise across a cut, since a mark's
    first character stands nowhere else in it.
    """
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(out, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(kind == "plain", out).when(kind == "psm", psm).otherwise(spm)
