"""Removal of repeated word sequences by compressed FM-indexes, one per shard of the corpus.

Every window of consecutive words has an anchor: the run of a few words within it that hashes
lowest. Equal windows have equal anchors, so only stretches around anchors that stand in more than
one place can hold repeated windows, and all stretches of an anchor go to one shard. A shard's
stretches are indexed (Burrows-Wheeler transform in a wavelet matrix) and streamed against the
index by backward search, whose matching statistics give the intervals of windows that occur again.

A very frequent anchor, such as that of a passage that a third of all documents share, would make a
shard of unbounded size. Its equal stretches are counted first, the different ones are cut into their
windows, and each different window is dealt out by its content and indexed once with its count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import discard, partitions_for, small_batches, stored, text_or_empty
from loanfate.llm.fm_index import FMIndex

#: Words of a window, and words of an anchor.
WINDOW, ANCHOR = 35, 5
#: Places of an anchor beyond which its stretches are cut into windows, and stretches of a shard.
#: They divide the work and change no result.
MOST_PLACES, SHARD_STRETCHES = 1000, 8000
#: Bytes of texts whose words are hashed at a time, which takes about a hundred times as much memory.
HASHED_BYTES = 1 << 20
#: Bytes of texts whose stretches are cut at a time; a longer text is cut by itself.
STRETCHED_BYTES = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd factors of the hashes of words and of anchors.
_BYTE, _WORD, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but blanks and the characters 0x09 to 0x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


class Powers:
    """Powers of the byte factor and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, f, np.uint64)]) for f in (_BYTE, inverse))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes).

    Equal words have equal hashes, whichever batch they are in.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    ends_at = np.append(starts[1:], len(data))
    # A word ends at the first blank behind its start, or where the next word or text starts.
    blanks = np.append(np.flatnonzero(~inside), len(data))
    ends = np.minimum(ends_at, blanks[np.searchsorted(blanks, starts)])
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(ends, offsets[text + 1])
    up, down = powers.upto(len(data) + 1)
    summed = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    return _mixed((summed[ends] - summed[starts]) * down[starts]), text


def hashes_of_texts(data: np.ndarray, offsets: np.ndarray, powers: Powers, most: int = HASHED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of texts of any length, about ``most`` bytes at a time, cut at blanks and between texts."""
    parts, start = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
    blanks = np.flatnonzero(_SPACE[data]) if len(data) > most else offsets[:0]
    while start < len(data):
        end = len(data)
        if end - start > most:
            cuts = [x[x > start + most][:1] for x in (blanks, offsets)]
            end = min([int(c[0]) for c in cuts if len(c)], default=end)
        within = np.unique(np.clip(offsets, start, end)) - start
        first = int(np.searchsorted(offsets, start, side="right")) - 1
        number = np.searchsorted(offsets, within[:-1] + start, side="right") - 1 if len(within) > 1 else np.array([first])
        hashes, text = word_hashes(data[start:end], within if len(within) > 1 else np.array([0, end - start]), powers)
        parts.append((hashes, number[text]))
        start = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def stretches(hashes: np.ndarray, text: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text number, first window, windows) of the stretches of windows with one anchor.

    A window's anchor is the leftmost of the ``anchor``-word runs within it that hash lowest.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    runs = np.zeros(len(hashes) - anchor + 1, np.uint64)
    for k in range(anchor):
        runs = runs * _WORD + hashes[k:k + len(runs)]
    runs = _mixed(runs)
    span = window - anchor + 1
    value, place, width = runs, np.arange(len(runs)), 1

    def lower(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The lower of each range and the one ``shift`` further; the left one of equals."""
        left = value[:size] <= value[shift:shift + size]
        return np.where(left, value[:size], value[shift:shift + size]), np.where(left, place[:size], place[shift:shift + size])

    while 2 * width <= span:
        value, place = lower(width, len(value) - width)
        width *= 2
    if width < span:
        value, place = lower(span - width, len(value) - (span - width))
    whole = np.flatnonzero(text[:n] == text[window - 1:])
    if not len(whole):
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    picked, owner = place[whole], text[whole]
    first = np.flatnonzero(np.r_[True, (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])])
    word_zero = np.searchsorted(text, owner[first], side="left")
    return runs[picked[first]], owner[first], whole[first] - word_zero, np.diff(np.append(first, len(whole)))


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch of strings without nulls, and where each begins."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return held, offsets - offsets[0]


def _anchor_rows(window: int, anchor: int):
    """A text's anchors with all their places: first window and windows of a stretch, packed into one long."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("tk", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = _text_bytes(batch.column(2))
            # Some texts at a time, a long one by itself.
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STRETCHED_BYTES)) - 1)
                yield from of_texts(ids[start:end], keys[start:end], data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start], powers)
                start = end

    def of_texts(ids, keys, data, offsets, powers: Powers) -> Iterator[pa.RecordBatch]:
        h, owner, first, count = stretches(*hashes_of_texts(data, offsets, powers), window, anchor)
        order = np.lexsort((first, h, owner))
        h, owner, span = h[order], owner[order], (first[order] << 8) | count[order]
        cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, int)
        rows = [
            pa.array(h[cut].view(np.int64)), pa.array(ids[owner[cut]]), pa.array(keys[owner[cut]]),
            pa.ListArray.from_arrays(pa.array(np.append(cut, len(h)).astype(np.int32)), pa.array(span)),
        ]
        whole = pa.RecordBatch.from_arrays(rows, schema=schema)
        for k in range(0, whole.num_rows, 50_000):
            yield whole.slice(k, 50_000)

    return run


def _stretch_rows(window: int):
    """The words of a text's stretches around the anchors that it is joined with."""
    schema = pa.schema([
        ("shard_key", pa.int64()), ("words", pa.binary()), ("id", pa.int64()), ("tk", pa.int64()), ("first", pa.int64()), ("hot", pa.bool_()),
    ])

    def of_text(doc_id: int, key: int, text: str, anchors: list[dict]) -> Iterator[tuple]:
        words = words_of(text)
        for a in anchors:
            for span in a["spans"]:
                first, count = span >> 8, span & 255
                yield a["h"], b" ".join(words[first:first + count + window - 1]), doc_id, key, first, a["hot"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in of_text(*(batch.column(c)[i].as_py() for c in range(4))):
                    held.append(row)
                    if len(held) >= 4096:
                        yield _columns(held, schema)
                        held = []
        if held:
            yield _columns(held, schema)

    return run


def _window_rows(window: int):
    """The windows of stretches (words, weight, s1, s2), with their places in the stretch."""
    schema = pa.schema([("words", pa.binary()), ("weight", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for held, *rest in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    words = held.split(b" ")
                    rows += [(b" ".join(words[k:k + window]), *rest, k) for k in range(len(words) - window + 1)]
                yield _columns(rows, schema)

    return run


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _search_shard(window: int):
    """Ranges of repeated windows in a shard's stretches (words, id, tk, first, weight)."""
    schema = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("first", pa.int64()), ("windows", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        # Equal stretches are indexed once, with their weights added up.
        held = table.column("words").combine_chunks().dictionary_encode()
        which = held.indices.to_numpy()
        weight = np.bincount(which, table.column("weight").to_numpy(), len(held.dictionary)).astype(np.int64)
        known: dict[bytes, int] = {}
        sequences = [np.array([known.setdefault(w, len(known) + 1) for w in s.split(b" ")], np.int64) for s in held.dictionary.to_pylist()]
        unit, first, last = FMIndex(sequences, weight, len(known)).repeated(window)
        # Back from different stretches to all rows that hold them.
        order = np.argsort(which, kind="stable")
        begins = np.searchsorted(which[order], unit, side="left")
        rows_of = np.searchsorted(which[order], unit, side="right") - begins
        part = np.repeat(np.arange(len(unit)), rows_of)
        row = order[begins[part] + np.arange(len(part)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)]
        start = table.column("first").to_numpy()[row] + first[part]
        columns = [table.column("id").to_numpy()[row], table.column("tk").to_numpy()[row], start, (last - first + 1)[part]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, tk, text): id and tk name a row's text; rows alike in both are alike in all that counts."""
    doc_id = F.col("doc_id").cast("long")
    text = text_or_empty()
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_places: int = MOST_PLACES, shard_stretches: int = SHARD_STRETCHES
) -> DataFrame:
    """(id, tk, spans): starts of ``window``-word windows that occur in more than one place, as ranges (first, windows).

    A text may have several rows. ``id`` is the doc_id (-1 for null) and ``tk`` the text's hash. See :func:`drop_repeated_words`.
    """
    if not 0 < anchor <= window or window - anchor >= 255:
        raise ValueError(f"an anchor of {anchor} words doesn't suit a window of {window}")
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _keyed(docs)
    found = keyed.select("id", "tk", "text").mapInArrow(_anchor_rows(window, anchor), "h long, id long, tk long, spans array<long>")
    anchors = stored(found, "anchors")
    places = anchors.groupBy("h").agg(F.sum(F.size("spans")).alias("places")).filter("places > 1")
    met = anchors.join(places.hint("merge"), "h")
    shared = stored(met.select("h", "id", "tk", "spans", (F.col("places") > most_places).alias("hot")), "shared-anchors")
    discard(anchors)

    by_text = shared.groupBy("id", "tk").agg(F.collect_list(F.struct("h", "hot", "spans")).alias("anchors"))
    asked = keyed.select("id", "tk", "text").join(by_text.hint("merge"), ["id", "tk"]).select("id", "tk", "text", "anchors")
    rows = asked.mapInArrow(_stretch_rows(window), "shard_key long, words binary, id long, tk long, first long, hot boolean")
    cut = stored(rows, "stretches")
    discard(shared)

    # Frequent stretches by two hashes of their words; their windows by two of theirs, with their counts.
    hot = cut.filter("hot")
    stretch = [F.xxhash64("words").alias("s1"), F.xxhash64(F.lit(7), F.col("words")).alias("s2")]
    name = [F.xxhash64("words").alias("id"), F.xxhash64(F.lit(7), F.col("words")).alias("tk")]
    different = hot.groupBy("words").agg(F.count("*").alias("weight")).select("words", "weight", *stretch)
    windows = stored(different.mapInArrow(_window_rows(window), "words binary, weight long, s1 long, s2 long, place long"), "windows")
    frequent = windows.groupBy("words").agg(F.sum("weight").alias("weight")).select(
        F.xxhash64("words").alias("shard_key"), "words", *name, F.lit(0).cast("long").alias("first"), "weight", F.lit(True).alias("hot")
    )
    plain = cut.filter("NOT hot").select("shard_key", "words", "id", "tk", "first", F.lit(1).cast("long").alias("weight"), F.lit(False).alias("hot"))
    shards = max(4 * partitions_for(docs), cut.count() // shard_stretches + 1)
    dealt = plain.unionByName(frequent).withColumn("shard", F.struct("hot", F.pmod("shard_key", F.lit(shards)).alias("part")))
    ranges = stored(_searched(dealt, window), "ranges")
    repeated = ranges.filter("NOT hot").select("id", "tk", F.array(F.struct("first", "windows")).alias("spans"))
    # Back from windows to the stretches that hold them, and from those to their places.
    found = windows.select("s1", "s2", "place", *name).join(ranges.filter("hot").select("id", "tk").hint("merge"), ["id", "tk"])
    places = stored(found.groupBy("s1", "s2").agg(F.collect_list("place").alias("places")), "window-places")
    # A text has a stretch once here, however often it repeats it; a stretch that many texts have is a skewed
    # key of the join, which adaptive execution splits.
    held = hot.select("id", "tk", "first", *stretch).groupBy("id", "tk", "s1", "s2").agg(F.collect_list("first").alias("firsts"))
    held = held.join(places.hint("merge"), ["s1", "s2"])
    one = F.lit(1).cast("long").alias("windows")
    starts = F.transform("places", lambda p: F.transform("firsts", lambda f: F.struct((f + p).alias("first"), one)))
    back = held.select("id", "tk", F.flatten(starts).alias("spans"))
    spans = stored(repeated.unionByName(back), "repeated-windows")
    discard(cut, windows, ranges, places)
    return spans


def _searched(dealt: DataFrame, window: int) -> DataFrame:
    search = _search_shard(window)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = search(table)
        return out.append_column("hot", pa.array([bool(key[0].as_py()["hot"])] * out.num_rows, pa.bool_()))

    needed = dealt.select("shard", "words", "id", "tk", "first", "weight")
    return needed.groupBy("shard").applyInArrow(run, "id long, tk long, first long, windows long, hot boolean")


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for each row: its words less those that repeated windows cover.

    A word goes if it lies in a window of ``window`` words whose sequence of words also starts
    anywhere else, in the same text or another; every place of a repeated window loses it. Windows
    are judged on the input. What stays is joined by single blanks. ``options`` are those of
    :func:`repeated_windows` and change no result.

    Null and empty texts have no words and an empty text; texts of fewer words than a window stay.
    Very long texts are treated whole. Ties of the anchors' hashes go to the left, alike in equal
    windows. Repeated rows, and equal texts, repeat each other and lose all windows. A null doc_id
    is kept. No rows give no rows. Columns other than doc_id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def of_text(text: str, spans: list[dict] | None) -> tuple[int, int, str]:
        words = words_of(text)
        if not spans:
            return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
        depth = np.zeros(len(words) + 1, np.int64)
        first = np.array([s["first"] for s in spans])
        np.add.at(depth, first, 1)
        np.add.at(depth, first + np.array([s["windows"] for s in spans]) + window - 1, -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        return len(words), len(words) - len(kept), b" ".join([words[k] for k in kept]).decode("utf-8", "surrogatepass")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts, spans = (c.to_pylist() for c in batch.slice(start, 256).columns)
                yield _columns([(i, *of_text(t, s)) for i, t, s in zip(ids, texts, spans)], schema)

    found = repeated_windows(docs, window, **options)
    spans = found.groupBy("id", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = _keyed(docs).join(spans.hint("merge"), ["id", "tk"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
