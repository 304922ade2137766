"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two different words are one inserted, deleted or replaced code point apart when their common prefix
and common suffix together reach the longer length minus one. Words meet only where that is
possible: an edit lies in one part of a word, so the rest before and behind that part is equal.
Words that share such a rest are a group. A group is cut into blocks of padded code-point matrices,
and pairs of blocks are compared densely. A large group is not compared: its part is halved, which
makes more of the word part of the key, until groups are small or the part is one code point wide;
then a group is bounded by the alphabet.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import partitions_for, stored, text_or_empty

#: Least code points of a word, least occurrences, and how many times as frequent a word's form is.
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many words (by its hash) loses a code point.
DROP_EVERY = 31
#: Words of a group that is compared rather than cut up further. Changes the work, not the result.
MOST_COMPARED = 256
#: Rows of a block; words beyond so many code points are compared one pair at a time.
BLOCK, WIDE = 8, 2048
#: Matrix cells that a task works on at a time.
CELLS = 4_000_000
#: Different words that a task counts before it sends them on.
HELD_WORDS = 200_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower_ascii(run: str) -> str:
    """Lower-case A-Z only."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def counted_words(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY
) -> DataFrame:
    """(word, n) of the whole texts' runs of Latin letters, lower-cased in A-Z, with n occurrences.

    Of a run whose CRC-32 with its document's id is divisible by ``drop_every`` one code point is
    left out; ``drop_every=0`` leaves all as they are. Only words of at least ``least_chars`` code
    points and ``least_count`` occurrences are returned. Each task counts its words before the
    shuffle, so a frequent word is one row of a task.

    Null and empty texts have no words; very long texts are read whole, like all others; repeated
    rows count each; a null doc_id counts as an empty one. No rows give no words.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    run_of = regex.compile(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[k:k + 50_000], pa.string()), pa.array(counts[k:k + 50_000], pa.int64())], schema=schema
                )
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                # A run is maximal, so one of fewer letters never matches in part.
                for found, n in Counter(run_of.findall(text)).items():
                    word = lower_ascii(found)
                    if drop_every:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_chars:
                                continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield from sent()
        yield from sent()

    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _group(length: Column, start: Column, end: Column) -> Column:
    """Key of the words of ``length`` code points, or one more, that are equal but for start to end."""
    behind = length - end
    rest = F.when(behind > 0, F.col("word").substr(F.col("size") - behind + 1, behind)).otherwise("")
    return F.xxhash64(length, start, end, F.col("word").substr(F.lit(1), start), rest)


def _parts(words: DataFrame) -> DataFrame:
    """Rows with the group of each half of each (word, n, size, length, start, end)."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("start").alias("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end").alias("end"))
    )
    cut = words.withColumn("half", F.explode(halves)).filter("half.start < half.end")
    cut = cut.select("word", "n", "size", "length", F.col("half.start").alias("start"), F.col("half.end").alias("end"))
    return cut.withColumn("g", _group(F.col("length"), F.col("start"), F.col("end")))


def near_words(words: DataFrame, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(word, other, other_n): both directions of every pair of different ``words`` (word, n) one edit apart.

    ``words`` has each word once. A word belongs to the groups of its own length and of one code
    point less, in which it is the longer one. Every near pair comes from one group: that of the
    part where its common prefix ends. Groups are counted before they are dealt out; those of one
    word are dropped, those over ``most_compared`` words are cut up in the next round. A key that a
    great many words share is a skewed key of the join with its count, which adaptive execution
    splits. Nulls and empty words have no near words. Words of any length are compared.
    """
    sized = words.filter("length(word) > 0").select("word", "n", F.length("word").alias("size"))
    lengths = F.array(F.col("size"), F.col("size") - 1)
    rows = sized.withColumn("length", F.explode(lengths)).filter("length > 0")
    rows = rows.select("word", "n", "size", "length", F.lit(0).alias("start"), F.col("length").alias("end"))
    found: DataFrame | None = None
    while found is None or not rows.isEmpty():
        parts = _parts(rows)
        counts = parts.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1")
        met = stored(parts.join(counts.hint("merge"), "g"), "spelling-groups")
        done = (F.col("members") <= most_compared) | (F.col("end") - F.col("start") <= 1)
        dealt = met.filter(done).repartition(partitions_for(words), "g").sortWithinPartitions("g")
        pairs = dealt.select("g", "word", "n", "length", "start", "end").mapInArrow(_compare_groups, "word string, other string, other_n long")
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.filter(~done).drop("g", "members")
    return found


def _compare_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a partition's rows (g, word, n, length, start, end), in which groups stand together."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])
    held: list[pa.RecordBatch] = []
    rows = 0

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = _near_rows(table)
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        for k in range(0, len(i), 50_000):
            a, b = (pa.array(np.concatenate(x)) for x in ((i[k:k + 50_000], j[k:k + 50_000]), (j[k:k + 50_000], i[k:k + 50_000])))
            yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], schema=schema)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 20_000:
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if last:
                yield from results(table.slice(0, last))
                held = table.slice(last).to_batches()
                rows -= last
    if rows:
        yield from results(pa.Table.from_batches(held))


def _near_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the near pairs within groups; groups of like width are worked on together."""
    g, length, start, end = (table.column(c).to_numpy() for c in ("g", "length", "start", "end"))
    words = table.column("word").to_pylist()
    firsts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    sizes = np.diff(firsts)
    width = np.ceil(np.log2(length[firsts[:-1]] + 1.0)).astype(int)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for kind in np.unique(width):
        groups = np.flatnonzero(width == kind)
        cells = np.cumsum(sizes[groups]) << int(kind)
        part = cells // CELLS
        for p in np.unique(part):
            some = groups[part == p]
            out += _compare_some(words, length, start, end, firsts[some], sizes[some])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each, padded with zeros to the longest; and their lengths."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(words), sizes.max(initial=1)), np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out, sizes


def _compare_some(words, length, start, end, firsts, sizes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of the groups that begin at ``firsts``: block pairs of padded matrices, some tiles at a time."""
    rows = np.concatenate([np.arange(f, f + s) for f, s in zip(firsts, sizes)])
    chosen = [words[r] for r in rows]
    # The last row of each matrix is empty: it fills up a group's last block.
    forward, long = _matrix([*chosen, ""])
    backward, _ = _matrix([*(w[::-1] for w in chosen), ""])
    width = forward.shape[1]
    block = BLOCK if width <= WIDE else 1
    blocks_of = -(-sizes // block)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    members = np.full((int(first_block[-1]), block), len(rows))
    at = np.arange(len(rows))
    group = np.repeat(np.arange(len(sizes)), sizes)
    within = at - np.repeat(np.cumsum(sizes) - sizes, sizes)
    members[first_block[group] + within // block, within % block] = at
    left, right = [], []
    for count in np.unique(blocks_of):
        a, b = np.triu_indices(int(count))
        base = first_block[:-1][blocks_of == count][:, None]
        left.append((base + a).ravel())
        right.append((base + b).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    out = []
    tiles = max(1, CELLS // (block * block * width))
    for k in range(0, len(left), tiles):
        i, j = members[left[k:k + tiles]], members[right[k:k + tiles]]
        prefix = _common(forward, i, j)
        suffix = _common(backward, i, j)
        size_i, size_j = long[i][:, :, None], long[j][:, None, :]
        near = prefix + suffix >= np.maximum(size_i, size_j) - 1
        near &= (i[:, :, None] < j[:, None, :]) & (size_j > 0)
        t, x, y = np.nonzero(near)
        a, b, p = i[t, x], j[t, y], prefix[t, x, y]
        row = rows[a]
        # The pair's own group: its shorter word has the group's length, and the prefix ends in its part.
        own = (np.minimum(long[a], long[b]) == length[row]) & (p >= start[row]) & ((p < end[row]) | (end[row] == length[row]))
        out.append((row[own], rows[b[own]]))
    return out


def _common(matrix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of rows i and j of every tile; the width where they are equal."""
    differ = matrix[i][:, :, None, :] != matrix[j][:, None, :, :]
    at = differ.argmax(axis=-1)
    return np.where(np.take_along_axis(differ, at[..., None], -1)[..., 0], at, matrix.shape[1])


def spelling_forms(words: DataFrame, ratio: int = RATIO, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n), each word once.

    ``form`` is the near word of largest n, the smallest in code-point order of several, if it is at
    least ``ratio`` times as frequent as the word; ``root`` is reached by following forms to the
    last. As n grows ``ratio``-fold with each form, a chain is short; each round doubles the steps.
    No words give no rows.
    """
    given = stored(words.select("word", "n"), "words")
    best = near_words(given, most_compared).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    joined = given.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    found = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    ), "spelling-forms")
    roots = stored(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if roots.join(step, "root", "left_semi").isEmpty():
            break
        followed = roots.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
        roots = stored(followed, "spelling-roots")
    whole = found.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """:func:`spelling_forms` of the :func:`counted_words` of whole texts, with the usual parameters."""
    return spelling_forms(counted_words(docs, **options))
