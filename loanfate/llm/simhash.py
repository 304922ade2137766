"""SimHash near-duplicates, found by a binary trie joined with itself; and near texts by their shingles.

The trie over the fingerprints' bits is walked in pairs of nodes: two nodes of one depth carry
the number of bits in which their paths differ, and a pair beyond the budget ends there. Its
top is cut into leaves of about even size by quantiles of the fingerprints, a bounded list;
the driver walks that top with itself and so finds the pairs of leaves that can hold links.
Each pair of leaves is one task's group, walked on from the leaves' depth to the last bit.

Texts of a Jaccard similarity are found by their SimHash first, the others by the rarest shingles of their
sets, and compared by the sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import discard, in_batches, shuffles_freed, slices, stored, text_or_empty
from loanfate.llm.components import connected_components

SEED = 42
BITS = 64
#: Distinct fingerprints that a leaf of the trie's top should hold.
LEAF_SIZE = 1024
#: Quantiles that reach the driver at most; beyond LEAF_SIZE times this, leaves grow instead.
MOST_QUANTILES = 16_384
#: Node pairs with no more pairs of fingerprints than this are compared at once.
SMALL = 48
#: Shingles hashed at a time.
CHUNK = 16_384
#: Node pairs of one depth that are walked together; more are walked in turn, to bound the memory.
NODES_AT_ONCE = 200_000
#: Shingle sets of one shingle that a block holds, about; blocks meet in pairs.
BLOCK = 256
#: Sets, about, whose shingles say which ones are common, and common shingles listed at most: for speed only.
ORDER_SAMPLE, ORDER_LIST = 20_000, 100_000
#: Shingles of prefixes searched at a time, about, in at most so many parts; they bound the disk only.
ENTRIES_AT_ONCE, MOST_PARTS = 20_000_000, 8
#: Shingles of the pairs compared at a time, about (or half of all), in at most so many parts; they bound the disk only.
SHINGLES_AT_ONCE, MOST_COMPARISONS = 1 << 27, 16
#: Bits of the parity sketch of a set, and at most of the table that says which rows may be asked.
SKETCH_BITS, ASKED_BITS = 512, 1 << 26

_TOP = np.uint64(1 << 63)


def _shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, some at a time."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        if words:
            yield np.array([digest(joined, SEED)], "<u8")
        return
    ends = list(accumulate(words, lambda at, w: at + 1 + len(w), initial=-1))
    starts = [e + 1 for e in ends[:-size]]
    ends = ends[size:]
    for k in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + CHUNK], ends[k:k + CHUNK])], "<u8")


def fingerprint(text: str, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; zero if it has no word.

    A-Z are lower-cased; words are what stands between blanks (space, \\t to \\r). A shorter
    text is one shingle. A bit is set if it is set in over half of the shingles' XXH64.
    """
    ones, n = np.zeros(BITS, np.int64), 0
    for h in _shingle_hashes(text, size):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint_hex(column: str) -> Column:
    """A fingerprint held as a long, as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def fingerprint_documents(docs: DataFrame, size: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns (longs) and ``fp`` long for each row; null texts count as empty."""
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            *held, texts = (c.to_pylist() for c in batch.columns)
            yield from in_batches(zip(*held, (signed(fingerprint(t, size)) for t in texts)), schema)

    source = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], text_or_empty().alias("text"))
    return source.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", fp long")


class TrieTop:
    """The top of the trie: leaves that cut the fingerprints into ranges with a common prefix.

    ``points`` are ascending unsigned fingerprints; a node with more than one of them is
    split. Leaves are numbered in ascending order.
    """

    def __init__(self, points: list[int]) -> None:
        self.children: list[tuple[int, int] | None] = []
        self.leaf_of: list[int] = []
        self.starts: list[int] = []
        self.depths: list[int] = []
        self._grow(points, 0, len(points), 0, 0)

    def _grow(self, points: list[int], low: int, high: int, prefix: int, depth: int) -> int:
        me = len(self.children)
        self.children.append(None)
        self.leaf_of.append(-1)
        if high - low <= 1 or depth == BITS:
            self.leaf_of[me] = len(self.starts)
            self.starts.append(prefix)
            self.depths.append(depth)
            return me
        one = prefix | (1 << (BITS - 1 - depth))
        mid = low
        while mid < high and points[mid] < one:
            mid += 1
        left = self._grow(points, low, mid, prefix, depth + 1)
        self.children[me] = left, self._grow(points, mid, high, one, depth + 1)
        return me

    def pairs(self, budget: int) -> list[tuple[int, int]]:
        """Pairs of leaves (first <= second) whose common depth differs in at most ``budget`` bits."""
        found, todo = [], [(0, 0, 0)]
        while todo:
            x, y, differing = todo.pop()
            cx, cy = self.children[x], self.children[y]
            if cx is None and cy is None:
                a, b = self.leaf_of[x], self.leaf_of[y]
                found.append((min(a, b), max(a, b)))
            elif cx is None:
                todo += [(x, cy[0], differing), (x, cy[1], differing)]
            elif cy is None:
                todo += [(cx[0], y, differing), (cx[1], y, differing)]
            else:
                todo += [(cx[0], cy[0], differing), (cx[1], cy[1], differing)]
                if differing < budget:
                    todo.append((cx[0], cy[1], differing + 1))
                    if x != y:
                        todo.append((cx[1], cy[0], differing + 1))
        return found


def walk_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ascending fingerprints that differ in at most ``budget`` bits.

    ``a`` and ``b`` each share their first ``depth`` bits; ``b`` None joins ``a`` with itself,
    each pair once. Node pairs of one depth are walked together, as ranges of the arrays.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    shift = np.uint64(BITS - depth)
    differing = 0 if own or not depth else int(np.bitwise_count((a[0] ^ b[0]) >> shift))
    todo = [(depth, np.array([[0], [len(a)], [0], [len(b)], [differing]], np.int64))] if differing <= budget else []
    while todo:
        depth, node = todo.pop()
        if node.shape[1] > NODES_AT_ONCE:
            todo.append((depth, node[:, NODES_AT_ONCE:]))
            node = node[:, :NODES_AT_ONCE]
        alo, ahi, blo, bhi, _ = node
        small = (ahi - alo) * (bhi - blo) <= SMALL
        if depth == BITS:
            small[:] = True
        if small.any():
            yield _compare(a, b, node[:, small], own, budget)
            node = node[:, ~small]
        if node.shape[1]:
            todo.append((depth + 1, _descend(a, b, node, own, np.uint64(1 << (BITS - 1 - depth)), budget)))


def _descend(a: np.ndarray, b: np.ndarray, node: np.ndarray, own: bool, bit: np.uint64, budget: int) -> np.ndarray:
    alo, ahi, blo, bhi, differing = node
    below = ~(bit | (bit - np.uint64(1)))
    amid = np.searchsorted(a, (a[alo] & below) | bit)
    bmid = np.searchsorted(b, (b[blo] & below) | bit)
    same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), bool)
    parts = [
        np.array([alo, amid, blo, bmid, differing]), np.array([amid, ahi, bmid, bhi, differing]),
        np.array([alo, amid, bmid, bhi, differing + 1]), np.array([amid, ahi, blo, bmid, differing + 1])[:, ~same],
    ]
    both = np.concatenate(parts, axis=1)
    return both[:, (both[0] < both[1]) & (both[2] < both[3]) & (both[4] <= budget)]


def _compare(a: np.ndarray, b: np.ndarray, node: np.ndarray, own: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    alo, ahi, blo, bhi, _ = node
    wide = bhi - blo
    counts = (ahi - alo) * wide
    which = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = alo[which] + k // wide[which], blo[which] + k % wide[which]
    keep = np.bitwise_count(a[i] ^ b[j]) <= budget
    if own:
        keep &= i < j
    return i[keep], j[keep]


def least_labels(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For nodes 0 to n-1 the least node linked with each, directly or through others."""
    label = np.arange(n)
    for i, j in links:
        while len(i):
            least = np.minimum(label[i], label[j])
            # The roots join first, so all that hangs below them follows.
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            while (further := label[label]).tobytes() != label.tobytes():
                label = further
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    return label


def trie_links(distinct: DataFrame, budget: int = 2, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints (``fp`` long) as their links do.

    A link is a pair that differs in at most ``budget`` bits. Each group gives, for every
    fingerprint linked within it, an edge to the least one connected with it there; so the
    components are those of all links while edges stay few.
    """
    return _trie_join(distinct.select("fp"), budget, leaf_size)


def _trie_join(rows: DataFrame, budget: int, leaf_size: int) -> DataFrame:
    """Edges between fingerprints (the only column) that differ in at most ``budget`` bits."""
    spark, names = rows.sparkSession, rows.columns
    wanted = min(MOST_QUANTILES, max(1, -(-rows.count() // leaf_size)))
    # With the top bit turned, the order of signed longs is that of the unsigned keys.
    ordered = rows.select(F.col(names[0]).bitwiseXOR(F.lit(-(1 << 63))).alias("turned"))
    shares = [k / wanted for k in range(wanted)]
    points = ordered.agg(F.percentile_approx("turned", shares, 10 * wanted)).first()[0] or []
    top = TrieTop(sorted({p + (1 << 63) for p in points}))
    pairs = top.pairs(budget)
    starts, depths = np.array(top.starts, np.uint64), np.array(top.depths)
    first = np.array([p[0] for p in pairs], np.int64)
    second = np.array([p[1] for p in pairs], np.int64)
    # Bounded by the quantiles.
    shared = spark.sparkContext.broadcast((starts, depths, first, second, *_pairs_by_leaf(first, second, len(starts))))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, _, _, listed, begin = shared.value
        for batch in slices(batches, 4096):
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf = np.searchsorted(starts, key.view(np.uint64), side="right") - 1
            copies = begin[leaf + 1] - begin[leaf]
            row = np.repeat(np.arange(len(key)), copies)
            k = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(listed[begin[leaf[row]] + k]), *taken.columns], names=["pair", *names])

    def join(table: pa.Table) -> pa.Table:
        starts, depths, first, second, _, _ = shared.value
        pair = table.column("pair")[0].as_py()
        columns = [table.column(c).to_numpy().astype(np.int64) for c in names]
        order = np.argsort(columns[0].view(np.uint64), kind="stable")
        columns = [c[order] for c in columns]
        key, named = columns[0].view(np.uint64), columns[min(1, len(columns) - 1)]
        x, y = first[pair], second[pair]
        if x == y:
            links = walk_pairs(key, None, int(depths[x]), budget)
        else:
            cut = int(np.searchsorted(key, starts[y]))
            links = ((i, j + cut) for i, j in walk_pairs(key[:cut], key[cut:], int(min(depths[x], depths[y])), budget))
        label = least_labels(len(key), links)
        linked = np.flatnonzero(label != np.arange(len(key)))
        return pa.table({"a": named[label[linked]], "b": named[linked]})

    dealt = rows.mapInArrow(deal, ", ".join(f"{c} long" for c in ["pair", *names]))
    return dealt.groupBy("pair").applyInArrow(join, "a long, b long")


def _pairs_by_leaf(first: np.ndarray, second: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair numbers listed by leaf, and where each leaf's list begins."""
    apart = first != second
    leaf = np.concatenate([first, second[apart]])
    number = np.concatenate([np.arange(len(first)), np.flatnonzero(apart)])
    order = np.argsort(leaf, kind="stable")
    return number[order], np.searchsorted(leaf[order], np.arange(leaves + 1))


def near_duplicate_classes(prints: DataFrame, budget: int = 2, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(fp, class_fp) for the fingerprints in ``prints`` that have a link; the others stand alone."""
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    edges = trie_links(distinct, budget, leaf_size)
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("class_fp"))


def near_duplicates(docs: DataFrame, budget: int = 2, size: int = 3, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) for each row: its fingerprint and the smallest doc_id reachable by links.

    Fingerprints link if they differ in at most ``budget`` bits. Rows with the same
    fingerprint (copies, all texts without words, repeated rows) meet as one before any
    search, so a group of copies of any size costs one row. A null text counts as empty. A
    null doc_id is reachable but never the smallest; a class of null ids only has a null
    component. No rows in, no rows out. Other columns are not read.
    """
    prints = stored(fingerprint_documents(docs, size), "document-fingerprints")
    heads = prints.groupBy("fp").agg(F.min("doc_id").alias("head"))
    classes = near_duplicate_classes(prints, budget, leaf_size)
    placed = stored(heads.join(classes, "fp", "left").withColumn("class_fp", F.coalesce("class_fp", "fp")), "heads")
    least = placed.groupBy("class_fp").agg(F.min("head").alias("component_id"))
    of_print = placed.join(least, "class_fp").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, size: int) -> np.ndarray:
    """XXH64 of the text's different word shingles, ascending, as signed numbers."""
    parts = [np.empty(0, "<u8"), *_shingle_hashes(text, size)]
    return np.unique(np.concatenate(parts)).view(np.int64)


def _common_shingles(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts (text_hash, text) holds often, ascending, and how often; a bounded list.

    It only puts shingles in an order in which common ones come last: any list gives the same pairs.
    """
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], schema=schema)

    one_in = max(1, source.count() // ORDER_SAMPLE)
    with shuffles_freed(source.sparkSession):
        sample = source.filter(F.pmod(F.xxhash64("text_hash"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "shingle long")
        often = sample.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= 4)
        found = often.orderBy(F.desc("n"), "shingle").limit(ORDER_LIST).toArrow()
    shingle, n = (found.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle)
    return shingle[order], n[order]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Of each of ``SKETCH_BITS`` shares of a set's shingles, whether their number is odd; as longs.

    Sets whose sketches differ in k bits differ in k shingles at least.
    """
    odd = np.bincount(shingles & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(source: DataFrame, similarity: float, size: int) -> DataFrame:
    """(doc_id, text_hash, fp, n, prefix, print, sketch) of each text: its set's hash and size, its first shingles in a common order,
    its SimHash, its set's :func:`parity_sketch`.

    Rare shingles come first. A set that is near another one holds at least its share ``similarity``
    of shingles of it, so the two share one of the shingles that come first, up to the number
    that may be lacking and one.
    """
    shared = source.sparkSession.sparkContext.broadcast(_common_shingles(source, size))
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "text_hash", "fp")), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("print", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def row(doc_id: int | None, text_hash: int, text: str) -> tuple:
        (common, often), x = shared.value, shingle_set(text, size)
        count = np.zeros(len(x), np.int64)
        if len(common):
            where = np.minimum(np.searchsorted(common, x), len(common) - 1)
            count = np.where(common[where] == x, often[where], 0)
        first = np.lexsort((x, count))[:len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
        return doc_id, text_hash, signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)), len(x), x[first], signed(fingerprint(text, size)), parity_sketch(x)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            yield from in_batches(map(row, *(c.to_pylist() for c in batch.columns)), schema)

    return source.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, fp long, n int, prefix array<long>, print long, sketch array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(fp, shingles) of the texts (fp, text)."""
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            yield from in_batches(zip(batch.column(0).to_pylist(), sets), schema)

    return texts.mapInArrow(run, "fp long, shingles array<long>")


def _may_be_near(similarity: float) -> Column:
    """Whether two sets that meet at their first common shingle can hold enough common ones from there on."""
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    return left * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6


def _sketches_allow(similarity: float) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles whose sketches are ``sketcha`` and ``sketchb`` can be near."""
    apart = [F.bit_count(F.col("sketcha")[k].bitwiseXOR(F.col("sketchb")[k])) for k in range(SKETCH_BITS // 64)]
    return sum(apart[1:], apart[0]) * (1 + similarity) <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-6


def _near_pairs(pairs: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, most: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity; only the sets of pairs that ``sketches`` allow are made.

    About ``most`` shingles are compared at a time, so the sets on disk are bounded.
    """
    first, second = (sketches.select(*[F.col(x).alias(y) for x, y in (("fp", c), ("n", f"n{c}"), ("sketch", f"sketch{c}"))]) for c in "ab")
    allowed = pairs.distinct().join(first.hint("merge"), "a").join(second.hint("merge"), "b").filter(_sketches_allow(similarity))
    pairs = stored(allowed.select("a", "b", "na", "nb"), "pairs")
    whole = pairs.agg(F.sum(F.col("na").cast("long") + F.col("nb"))).first()[0] or 0
    parts = max(1, min(MOST_COMPARISONS, -(-whole // most)))
    found = []
    for part in range(parts):
        some = pairs.filter(F.pmod(F.xxhash64("b"), F.lit(parts)) == part).select("a", "b")
        asked = some.select(F.col("a").alias("fp")).unionByName(some.select(F.col("b").alias("fp"))).distinct()
        held = stored(sets_of(asked), "asked-sets")
        both = some.join(held.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
        both = both.join(held.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        near = common * (1 + similarity) >= similarity * (F.size("sa") + F.size("sb")) - 1e-6
        found.append(stored(both.filter(near).select("a", "b"), "near-pairs"))
        discard(held)
    discard(pairs)
    return reduce(DataFrame.unionByName, found)


def print_pairs(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Pairs (a, b) of different ``fp`` that connect those of ``prints`` (fp, print) whose SimHash ``print`` is linked.

    Prints link at ``budget`` or fewer differing bits, found by the trie. A pair holds the least ``fp``
    of a print, or of the least print connected with it in a group of the trie.
    """
    leads = stored(prints.groupBy("print").agg(F.min("fp").alias("lead")), "print-leads")
    same = prints.join(leads, "print").filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    links = trie_links(leads.select(F.col("print").alias("fp")), budget)
    near = links.join(leads.select(F.col("print").alias("a"), F.col("lead").alias("la")), "a")
    near = near.join(leads.select(F.col("print").alias("b"), F.col("lead").alias("lb")), "b")
    return same.unionByName(near.select(F.col("la").alias("a"), F.col("lb").alias("b")))


def _met_sets(classed: DataFrame, part: int, parts: int, least: int) -> DataFrame:
    """(shingle, fp, n, at, p, held, lead) for the shingles of one part that ``least`` or more sets hold in their prefixes, not all of one class ``p``.

    ``held`` says how many hold it, ``lead`` is the least of them.
    """
    entries = classed.select("fp", "n", "p", F.posexplode("prefix").alias("at", "shingle")).filter(F.pmod("shingle", F.lit(parts)) == part)
    groups = entries.groupBy("shingle").agg(F.count("*").alias("held"), F.min("fp").alias("lead"), F.min("p").alias("low"), F.max("p").alias("high"))
    shared = stored(groups.filter(F.col("held") >= least).filter("low <> high").select("shingle", "held", "lead"), "shared-shingles")
    met = stored(entries.join(shared.hint("merge"), "shingle"), "met-sets")
    discard(shared)
    return met


def _lead_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each shingle's lead with all others that hold it and are of other classes."""
    lead = met.filter("fp = lead").select("shingle", *[F.col(x).alias(y) for x, y in (("fp", "a"), ("n", "na"), ("at", "ata"), ("p", "pa"))])
    other = met.filter("fp <> lead").select("shingle", *[F.col(x).alias(y) for x, y in (("fp", "b"), ("n", "nb"), ("at", "atb"), ("p", "pb"))])
    return other.join(lead.hint("merge"), "shingle").filter("pa <> pb").filter(_may_be_near(similarity)).select("a", "b")


def _other_pairs(met: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) of sets other than a shingle's lead that hold it and are of different classes, in blocks of about ``block``."""
    placed = met.filter("fp <> lead")
    apart = placed.groupBy("shingle").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low <> high").select("shingle")
    blocks = F.ceil(F.col("held") / block).cast("long")
    left = placed.join(apart.hint("merge"), "shingle").join(sketches.select("fp", "sketch").hint("merge"), "fp").select(
        "shingle", "fp", "n", "at", "p", "sketch", F.pmod(F.xxhash64("fp"), blocks).alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    held = ("fp", "n", "at", "p", "sketch")
    one = left.select("shingle", F.col("mine").alias("i"), F.col("other").alias("j"), *[F.col(x).alias(f"{x}a") for x in held])
    two = left.select("shingle", F.col("other").alias("i"), F.col("mine").alias("j"), *[F.col(x).alias(f"{x}b") for x in held])
    crossed = one.hint("merge").join(two, ["shingle", "i", "j"]).filter((F.col("fpa") < F.col("fpb")) & (F.col("pa") != F.col("pb")))
    near = crossed.filter(_may_be_near(similarity)).filter(_sketches_allow(similarity))
    return near.select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))


def similar_classes(
    prefixes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int = BLOCK
) -> DataFrame:
    """(fp, class_fp) for shingle sets that are near another one, or linked with it.

    ``prefixes`` has (fp, n, prefix, print, sketch) of every different set (:func:`_prefixes`); ``sets_of`` gives
    (fp, shingles) for a table of asked ``fp``. Near are sets with at least this Jaccard similarity,
    decided by the sets themselves. Sets linked by SimHash are compared first (:func:`print_pairs`); what
    that connects is not compared again. An exact search for the rest follows: near sets share a shingle of
    their prefixes, so no pair is missed.
    Sets that share one are compared with one of them. Then all others that share it and are
    not connected yet are compared with each other, in blocks of about ``block`` sets, each pair of
    blocks a key of its own: pairs that are connected already change no class, so a large group of
    near copies costs few. Pairs whose parity sketches differ in more bits than near sets may in shingles
    are not compared.

    The shingles of prefixes are searched in parts, and pairs compared in parts, so neither all of the
    one nor all sets of the other are on disk at once.
    """
    sketches = prefixes.select("fp", "n", "sketch")
    shingles, entries = prefixes.agg(F.sum(F.col("n").cast("long")), F.sum(F.size("prefix").cast("long"))).first()
    most, parts = max(SHINGLES_AT_ONCE, (shingles or 0) // 2), max(1, min(MOST_PARTS, -(-(entries or 0) // ENTRIES_AT_ONCE)))

    def classed(found: DataFrame) -> DataFrame:
        of_pairs = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("p"))
        return stored(prefixes.select("fp", "n", "prefix").join(of_pairs, "fp", "left").withColumn("p", F.coalesce("p", "fp")), "prefixes")

    def searched(classes: DataFrame, least: int, pairs_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        found = []
        for part in range(parts):
            met = _met_sets(classes, part, parts, least)
            found.append(stored(pairs_of(met).distinct(), "part-pairs"))
            discard(met)
        discard(classes)
        near = _near_pairs(reduce(DataFrame.unionByName, found), sketches, sets_of, similarity, most)
        discard(*found)
        return near

    linked = _near_pairs(print_pairs(prefixes.select("fp", "print")), sketches, sets_of, similarity, most)
    found = searched(classed(linked), 2, lambda met: _lead_pairs(met, similarity)).unionByName(linked)
    others = searched(classed(found), 3, lambda met: _other_pairs(met, sketches, similarity, block))
    return connected_components(found.unionByName(others)).select(F.col("node").alias("fp"), F.col("component").alias("class_fp"))


def _asked_rows(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` (keys, text) that ``asked`` (keys) may hold, and few others; no row is moved.

    A table of sixteen bits or more for each asked row, but ``ASKED_BITS`` at most, goes to every task; beyond that more others stay.
    """
    spark, size = rows.sparkSession, min(ASKED_BITS, 1 << max(10, (16 * asked.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    with shuffles_freed(spark):
        bits = asked.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
        found = bits.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared, names = spark.sparkContext.broadcast(table), [*keys, "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            yield batch.select(names).filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    source = rows.select(*names)
    return source.withColumn("place", place).mapInArrow(run, source.schema)


def one_of_each_group(docs: DataFrame, similarity: float = 0.8, size: int = 5, leaf_size: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns as they are.

    Near are texts whose sets of ``size``-word shingles have at least this Jaccard
    similarity (:func:`similar_classes`); a shorter text is one shingle. Classes are closed
    under nearness. The row with the smallest doc_id stays (null ids last, then the smaller hash
    of the text). Rows that agree in doc_id and text are one row. Texts without words are copies
    of each other. ``leaf_size`` sets are compared with each other in one block.
    """
    names = docs.columns
    text_hash = F.xxhash64(F.col("text").isNull(), "text")
    # The row is held as one value, so the keys' names cannot clash with its columns.
    keys = ["r_id", "r_null", "r_hash"]
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("r_id"),
        F.col("doc_id").isNull().alias("r_null"), text_hash.alias("r_hash"),
    )

    def named(head: str) -> list[Column]:
        return [F.coalesce(f"{head}.doc_id", F.lit(0)).alias("r_id"), F.col(f"{head}.doc_id").isNull().alias("r_null"),
                F.col(f"{head}.text_hash").alias("r_hash")]

    def sets_of(asked: DataFrame) -> DataFrame:
        """Made anew from the text of one row of each set, so that no table holds the sets of all texts."""
        rows = stored(heads.join(asked, "fp").select("fp", *named("head")), "asked-rows")
        texts = _asked_rows(held.select(*keys, F.coalesce(F.col("row.text"), F.lit("")).alias("text")), rows, keys)
        return _sets(texts.join(rows.hint("merge"), keys).dropDuplicates(keys).select("fp", "text"), size)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), text_or_empty().alias("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    of_print = _prefixes(source, similarity, size).groupBy("fp").agg(F.min(rank).alias("head"), F.min(F.struct("n", "prefix", "print", "sketch")).alias("set"))
    heads = stored(of_print.select("fp", "head", "set.n", "set.prefix", "set.print", "set.sketch"), "heads")
    classes = similar_classes(heads.filter("n > 0").select("fp", "n", "prefix", "print", "sketch"), sets_of, similarity, leaf_size)
    kept = (
        heads.join(classes, "fp", "left").groupBy(F.coalesce("class_fp", "fp").alias("class_fp"))
        .agg(F.min("head").alias("head"))
    )
    kept = stored(kept.select(*named("head")), "kept")
    discard(heads)
    once = held.join(kept, keys).dropDuplicates(keys)
    return once.select(*[F.col("row").getField(c).alias(c) for c in names])
