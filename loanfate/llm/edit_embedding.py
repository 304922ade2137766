"""Document fingerprints by randomised edit embedding.

A walk reads a text: at each step it stands at some character, writes it out, and goes on to
the next character if the shared random bit of (step, character) is one, else stays. All texts
share the bits, so where two texts agree after an edit their walks soon fall into step again,
and the Hamming distance of what they write follows the edit distance of the texts. The
fingerprint samples the written positions and keeps some bits of each. Bands of sampled
positions find candidate pairs, and whole fingerprints verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import id_boundaries, in_batches, partitions_for, range_bucket, stored, text_or_empty
from loanfate.llm.components import connected_components
from loanfate.llm.simhash import least_labels

#: Sampled positions; four bits are kept of each, a hex digit.
SAMPLES = 256
#: Steps after which the shared random bits repeat, and classes of characters that have bits of their own.
PERIOD, CLASSES = 1 << 14, 256
SEED = 20_240_229
#: Characters walked together by a task.
CHARS_AT_ONCE = 6_000_000
#: Texts below which a step for all of them costs more than steps for each.
FEW = 48
#: Sampled positions of a band, and the likeness that makes a pair near.
BAND, NEAR = 8, 0.8
#: Fingerprints of one band value that a task compares with as many others.
BLOCK = 2048
#: Agreement of two sampled positions by chance.
CHANCE = 1 / 16

_FAR = 1 << 44
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Walks:
    """The shared randomness: how long walks stay, which positions are sampled, which bits are kept."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        ones = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
        ones[:, ::250] = True  # no walk stays longer than fits a byte
        stay = np.zeros((CLASSES, PERIOD), np.uint8)
        after = np.ones(CLASSES, np.int64)  # from the first step of the next period
        for j in [*range(PERIOD - 1, -1, -1)]:
            after = np.where(ones[:, j], 1, after + 1)
            stay[:, j] = after
        self.stay = stay.ravel()
        self.stay_bytes = self.stay.tobytes()
        self.samples = samples
        self.class_salt = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        self.salts = rng.integers(1, 1 << 62, samples).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        # Sample k of a walk of T steps is the last record below T in an endless shared sequence.
        # After record p the next lies beyond m with probability (p + 1) / (m + 1), so a sample is
        # uniform over the T steps, and the same for walks of nearly the same length.
        self.records = []
        for _ in range(samples):
            record = [0]
            while record[-1] < _FAR:
                record.append(int((record[-1] + 1) / (1.0 - rng.random())))
            self.records.append(np.array(record))

    def class_starts(self, points: np.ndarray) -> np.ndarray:
        """Where each character's row of stays starts: ASCII has classes of its own, others share."""
        mixed = (points.astype(np.uint64) * self.class_salt) >> np.uint64(57)
        return np.where(points < 128, points, 128 + mixed.astype(np.uint32)).astype(np.int32) * PERIOD

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """(walks, samples): the sampled steps of walks with so many steps, one at least."""
        return np.column_stack([r[np.searchsorted(r, steps, side="left") - 1] for r in self.records])

    def kept(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Four bits of each sample from what is written and where."""
        x = (points.astype(np.uint64) * _MIX + at.astype(np.uint64)) * self.salts
        x ^= x >> np.uint64(29)
        return ((x * _MIX) >> np.uint64(60)).astype(np.uint8)


_WALKS: dict[tuple[int, int], Walks] = {}


def shared_walks(samples: int = SAMPLES, seed: int = SEED) -> Walks:
    """Made once in each Python worker."""
    if (samples, seed) not in _WALKS:
        _WALKS[samples, seed] = Walks(samples, seed)
    return _WALKS[samples, seed]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def walk(walks: Walks, starts: np.ndarray, lengths: np.ndarray, base: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entered, steps): the step at which each walk enters each of its characters, and its last step.

    Text r is ``base[starts[r]:starts[r] + lengths[r]]`` and its walk begins at step
    ``first[r]``. Texts are walked side by side, the longest first, so that at each
    character the rows that still go on come first; the last few go on one by one.
    """
    order = np.argsort(-lengths, kind="stable")
    at, size, now = starts[order], lengths[order], first[order].astype(np.int64)
    entered = np.empty(len(base), np.int64)
    mask = PERIOD - 1
    side_by_side = int(size[FEW]) if len(size) > FEW else 0
    alive = np.searchsorted(-size, -np.arange(side_by_side), side="left")  # texts longer than i
    for i, n in enumerate(alive.tolist()):
        place = at[:n] + i
        t = now[:n]
        entered[place] = t
        t += walks.stay[base[place] + (t & mask)]
    stay = walks.stay_bytes
    for r in range(min(FEW, len(size))):
        if size[r] > side_by_side:
            t, low = int(now[r]), int(at[r]) + side_by_side
            times = []
            for b in base[low:int(at[r] + size[r])].tolist():
                times.append(t)
                t += stay[b + (t & mask)]
            entered[low:low + len(times)] = times
            now[r] = t
    steps = np.empty(len(size), np.int64)
    steps[order] = now
    return entered, steps


class Prints:
    """Fingerprints of texts and of texts that share their start with them."""

    def __init__(self, walks: Walks, texts: list[str]) -> None:
        self.walks = walks
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if texts else np.empty(0, np.int64)
        self.points = code_points("".join(texts))
        self.base = walks.class_starts(self.points)
        self.entered, self.steps = walk(walks, self.starts, self.lengths, self.base, np.zeros(len(texts), np.int64))

    def own(self) -> list[bytes]:
        at = self.walks.positions(np.maximum(self.steps, 1))
        return [
            self._digits([(self.entered[s:s + n], self.points[s:s + n])], at[r])
            for r, (s, n) in enumerate(zip(self.starts.tolist(), self.lengths.tolist()))
        ]

    def edited(self, heads: np.ndarray, donors: np.ndarray, tails: np.ndarray) -> list[bytes]:
        """Fingerprints of texts made of the first ``heads`` characters of each text and the first
        ``tails`` characters of the text ``donors``; only the tails are walked anew."""
        first = np.where(heads < self.lengths, self.entered[np.minimum(self.starts + heads, max(0, len(self.entered) - 1))]
                         if len(self.entered) else 0, self.steps)
        parts = [self.base[s:s + n] for s, n in zip(self.starts[donors].tolist(), tails.tolist())]
        base = np.concatenate(parts) if parts else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(tails)[:-1]]).astype(np.int64) if len(tails) else tails
        entered, steps = walk(self.walks, starts, tails, base, first)
        at = self.walks.positions(np.maximum(steps, 1))
        out = []
        for r, (s, n, d, e, m) in enumerate(zip(self.starts.tolist(), heads.tolist(), self.starts[donors].tolist(), starts.tolist(), tails.tolist())):
            out.append(self._digits([
                (self.entered[s:s + n], self.points[s:s + n]), (entered[e:e + m], self.points[d:d + m]),
            ], at[r]))
        return out

    def _digits(self, parts: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> bytes:
        """The kept bits of one text, a byte each; the text's characters come in parts with their steps."""
        entered = np.concatenate([p[0] for p in parts]) if len(parts) > 1 else parts[0][0]
        if not len(entered):
            return bytes(self.walks.samples)
        points = np.concatenate([p[1] for p in parts]) if len(parts) > 1 else parts[0][1]
        written = points[np.searchsorted(entered, at, side="right") - 1]
        return self.walks.kept(written, at).tobytes()


def fingerprint_hex(digits: bytes) -> str:
    """A hex digit for each sample."""
    return digits.translate(b"0123456789abcdef" + bytes(240)).decode()


def likeness(a: bytes, b: bytes) -> float:
    """Share of agreeing samples beyond what chance gives: 1 for equal fingerprints, about 0 for unrelated ones."""
    agree = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / max(1, len(a))
    return max(0.0, (agree - CHANCE) / (1 - CHANCE))


def bands_shared(a: bytes, b: bytes, band: int = BAND) -> int:
    return sum(a[k:k + band] == b[k:k + band] for k in range(0, len(a), band))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each whole text; a null text is empty, and its fingerprint all zeros."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = shared_walks(samples, seed)
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for held in _chunks(rows):
            prints = Prints(walks, [t for _, t in held]).own()
            yield from in_batches(((i, len(t), fingerprint_hex(p)) for (i, t), p in zip(held, prints)), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (…, text) in lists of about CHARS_AT_ONCE characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The next document is the next row by doc_id, after the last one the first; null ids come
    first and rows of one id are ordered by text. The edited text has its last
    ``n_chars // 2`` code points replaced by as many first ones (or all) of the next
    document's text. Null texts are empty; a table of one row is its own next. Returns
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    bands_edited, bands_next), the last two the numbers of bands shared. Columns other than
    doc_id and text are not read.

    Texts are shuffled once, into ranges of doc_id; the first document of each range goes
    to the range before it too, so every task finds all next documents in its own rows.
    """
    least = -(1 << 63)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"),
    )
    ids = keyed.select("key")
    smallest = ids.agg(F.min("key")).first()[0]
    cuts = [c for c in id_boundaries(ids, "key", partitions_for(docs)) if c != smallest]
    last = len(cuts)
    bucket = range_bucket("key", cuts)
    opens = F.when(F.col("key") == F.lit(least if smallest is None else smallest), F.lit(last))
    if cuts:
        opens = opens.when(F.col("key").isin(cuts), bucket - 1)
    copies = F.array_compact(F.array(
        F.struct(bucket.alias("bucket"), F.lit(False).alias("beyond")),
        F.when(opens.isNotNull(), F.struct(opens.alias("bucket"), F.lit(True).alias("beyond"))),
    ))
    dealt = keyed.select("key", "doc_id", "text", F.inline(copies)).repartitionById(last + 1, F.col("bucket").cast("int"))
    ordered = dealt.sortWithinPartitions("bucket", "beyond", "key", "text").select("beyond", "doc_id", "text")
    return ordered.mapInArrow(_compare_rows(samples, seed), COMPARED_DDL)


COMPARED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("bands_edited", pa.int64()), ("bands_next", pa.int64()),
])
COMPARED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, bands_edited long, bands_next long"
)


def _compare_rows(samples: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = shared_walks(samples, seed)

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        held: list[tuple] = []
        for more in _chunks(rows()):
            held += more
            yield from in_batches(_compared(walks, held), COMPARED)
            held = held[-1:]  # the next chunk knows its next document
            if held and held[0][0]:
                return

    return run


def _compared(walks: Walks, rows: list[tuple]) -> Iterator[tuple]:
    """Results for all rows but the last, and but those beyond the range."""
    n = 0
    while n < len(rows) - 1 and not rows[n][0]:
        n += 1
    if not n:
        return
    texts = [t for _, _, t in rows[:n + 1]]
    prints = Prints(walks, texts)
    lengths = prints.lengths[:n]
    heads = lengths - lengths // 2
    tails = np.minimum(lengths // 2, prints.lengths[1:])
    own = prints.own()
    pad = np.zeros(1, np.int64)  # the last text has no next one here
    edited = prints.edited(np.concatenate([heads, pad]), np.concatenate([np.arange(1, n + 1), pad]), np.concatenate([tails, pad]))
    for r in range(n):
        text = texts[r][:heads[r]] + texts[r + 1][:tails[r]]
        yield (
            rows[r][1], int(lengths[r]), hashlib.sha256(text.encode()).hexdigest(), fingerprint_hex(own[r]), fingerprint_hex(edited[r]),
            likeness(own[r], edited[r]), likeness(own[r], own[r + 1]), bands_shared(own[r], edited[r]), bands_shared(own[r], own[r + 1]),
        )


def near_classes(prints: DataFrame, band: int = BAND, near: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(fingerprint, class_fingerprint) for the fingerprints that are near another one.

    Distinct fingerprints that share a band meet, and every such pair is verified by
    :func:`likeness`. The members of one band value are dealt into parts of about ``block``,
    and each pair of parts is a group, so no value's members meet in one task. A group
    gives edges that connect what its verified pairs connect, not the pairs. Copies of a
    fingerprint are one member.
    """
    distinct = stored(
        prints.select("fingerprint").filter("fingerprint IS NOT NULL").distinct().withColumn("fp", F.xxhash64("fingerprint")), "edit-prints"
    )
    at = F.sequence(F.lit(1), F.length("fingerprint"), F.lit(band))
    bands = F.transform(at, lambda k: F.xxhash64(k, F.substr("fingerprint", k, F.lit(band))))
    members = distinct.select("fp", "fingerprint", F.explode(bands).alias("value"))
    sizes = members.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    parts = sizes.select("value", F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    placed = members.join(parts, "value").withColumn("mine", mine)
    # Each part meets every other part of its value, once as the first and once as the second.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = placed.select("value", "fp", "fingerprint", "mine", other).select(
        "value", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp", "fingerprint",
    )
    edges = met.groupBy("value", "low", "high").applyInArrow(_verify(near), "a long, b long")
    classes = connected_components(edges)
    named = classes.join(distinct, classes["node"] == distinct["fp"]).select("component", "fingerprint")
    first = named.groupBy("component").agg(F.min("fingerprint").alias("class_fingerprint"))
    return named.join(first, "component").select("fingerprint", "class_fingerprint")


def _verify(near: float):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        digits = np.array([list(x.encode()) for x in table.column("fingerprint").to_pylist()], np.uint8)
        agree = (near * (1 - CHANCE) + CHANCE) * digits.shape[1]

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(1, len(fp)):
                j = np.flatnonzero((digits[:i] == digits[i]).sum(axis=1) >= agree - 1e-9)
                yield np.full(len(j), i), j

        label = least_labels(len(fp), links())
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[label[linked]], "b": fp[linked]})

    return run
