"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over character n-grams
is learned, which tells the languages with a one from those with a zero. A text's margins on
all bits are compared with every codeword by a loss, each bit weighed by how well its
classifier did on that language; the nearest codeword wins, and a close second flags the
answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import in_batches, slices, text_or_empty, text_slices

#: Hash buckets of character trigrams.
BUCKETS = 1 << 15
#: Documents at most, about, on which the bit classifiers are measured for their weights.
MEASURED_DOCUMENTS = 5_000
#: Languages up to which all splits into two sets are bits; more languages get random codewords.
EXHAUSTIVE_UP_TO = 6
#: A runner-up with at least this share of the winner's probability makes an answer ambiguous.
AMBIGUOUS_FROM = 0.5
#: Added to each bucket's count.
PRIOR = 0.5
#: Bytes of texts worked on at once.
BYTES_AT_ONCE = 1_000_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACE = 32
#: Bytes as they are counted: letters in lower case, bytes of other scripts as they are, all else a space.
_SYMBOL = np.full(256, _SPACE, np.uint8)
_SYMBOL[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _SYMBOL[_c] = _SYMBOL[_c - 32] = _c


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """(languages, bits) of +1 and -1, no two rows alike and no bit the same for all.

    Up to ``EXHAUSTIVE_UP_TO`` languages every split into two sets is a bit, so any two
    codewords differ in over half of them. More languages get random balanced bits, ten
    for each doubling.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE_UP_TO:
        splits = np.arange(2 ** (languages - 1) - 1)
        rows = [np.ones(len(splits), np.int8)]
        rows += [np.where(splits >> k & 1, 1, -1).astype(np.int8) for k in range(languages - 1)]
        return np.array(rows)
    rng = np.random.default_rng(seed)
    half = np.arange(languages) % 2 * 2 - 1
    bits = 10 * int(np.ceil(np.log2(languages)))
    return np.array([rng.permutation(half) for _ in range(bits)], np.int8).T.copy()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams, number of each text's trigrams).

    A text stands between single spaces; trigrams with two spaces in a row do not count.
    """
    encoded = [b" " + t.lower().encode() + b"  " for t in texts]
    sizes = np.array([len(e) for e in encoded], np.int64)
    symbols = _SYMBOL[np.frombuffer(b"".join(encoded), np.uint8)]
    a, b, c = symbols[:-2].astype(np.uint32), symbols[1:-1].astype(np.uint32), symbols[2:]
    blank = symbols == _SPACE
    keep = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    # The next text's first space never joins: two spaces stand before it.
    mixed = ((a * np.uint32(65_599) + b) * np.uint32(65_599) + c) * np.uint32(2_654_435_761)
    counts = np.add.reduceat(np.append(keep, [False, False]).astype(np.int64), np.cumsum(sizes) - sizes) if len(sizes) else sizes
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[keep], counts


@dataclass
class Model:
    """Languages in ascending order, their codewords, the bits' n-gram weights, and weights by language and bit."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """(texts, bits): mean weight of a text's trigrams, grown with the root of their number."""
        out = np.zeros((len(texts), self.words.shape[1]))
        for low, high in text_slices(texts, BYTES_AT_ONCE):
            buckets, counts = trigrams(texts[low:high])
            ends = np.cumsum(counts)
            used = np.flatnonzero(counts)
            if len(used) and out.shape[1]:
                sums = np.add.reduceat(self.weights[buckets], (ends - counts)[used], axis=0)
                out[low + used] = sums / np.sqrt(counts[used])[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its probability, the runner-up's) by loss-weighted decoding."""
        z = np.clip(margins, -50, 50)[:, None, :] * self.words[None]
        loss = (np.logaddexp(0, -z) * self.trust[None]).sum(axis=2)
        nearer = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = nearer / nearer.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        rows = np.arange(len(share))
        top = share[rows, best]
        share[rows, best] = 0
        return best, top, share.max(axis=1, initial=0)


def training_rows(docs: DataFrame, fold: int = 0, folds: int = 5) -> Column:
    """Whether a row is learned from: a language is given and its id is not of the held-out fold."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(fold, folds), F.lit(False))


def held_out(fold: int = 0, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def learn(docs: DataFrame, fold: int = 0, folds: int = 5, measured: int = MEASURED_DOCUMENTS) -> Model:
    """Learn from all training rows (:func:`training_rows`) of (doc_id, text, lang).

    Trigram counts of each language are summed over the whole table; the driver gets at most
    ``BUCKETS`` numbers for each language. The bits' weights come from about ``measured``
    documents, chosen by a hash of the id.
    """
    rows = docs.filter(training_rows(docs, fold, folds)).select("doc_id", "lang", "text")
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), PRIOR)
    who = np.array([place[x] for x in sums.column("lang").to_pylist()], np.int64)
    # Bucket -1 has the number of documents.
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    gram = bucket >= 0
    np.add.at(counts, (who[gram], bucket[gram]), n[gram])
    total = int(n[~gram].sum())
    words = codewords(len(languages))
    rates = counts / counts.sum(axis=1, keepdims=True) if languages else counts
    ones, zeros = words > 0, words < 0
    weights = np.zeros((BUCKETS, words.shape[1]), np.float32)
    for k in range(words.shape[1]):
        weights[:, k] = np.log(rates[ones[:, k]].mean(axis=0)) - np.log(rates[zeros[:, k]].mean(axis=0))
    model = Model(languages, words, weights, np.ones(words.shape))
    if words.shape[1]:
        share = min(1.0, measured / max(1, total))
        chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))
        model.trust = _trust(model, rows.filter(chosen))
    return model


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of a whole partition, and under bucket -1 its documents."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in slices(batches, 2048):
        by_language: dict[str, list[str]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            held = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
            documents[language] = documents.get(language, 0) + len(texts)
            for low, high in text_slices(texts, 4 * BYTES_AT_ONCE):
                held += np.bincount(trigrams(texts[low:high])[0], minlength=BUCKETS)
    for language, held in counts.items():
        bucket = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([
            pa.array([language] * (len(bucket) + 1)),
            pa.array(np.append(bucket, -1).astype(np.int32)), pa.array(np.append(held[bucket], documents[language])),
        ], schema=schema)


def _trust(model: Model, rows: DataFrame) -> np.ndarray:
    """(languages, bits): share of a language's documents whose margin has the codeword's sign, its rows
    scaled to a mean of one. A language that was not measured trusts all bits alike."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = {x: k for k, x in enumerate(model.languages)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("right", pa.list_(pa.int32()))])
        for batch in slices(batches, 512):
            margins = shared.value.margins(batch.column(1).to_pylist())
            languages = batch.column(0).to_pylist()
            right = (margins * shared.value.words[[place[x] for x in languages]] > 0).astype(np.int32)
            yield from in_batches(zip(languages, right.tolist()), schema)

    marked = rows.select("lang", "text").mapInArrow(run, "lang string, right array<int>")
    flat = marked.select("lang", F.posexplode("right").alias("bit", "right"))
    found = flat.groupBy("lang", "bit").agg(F.avg(F.col("right").cast("double")).alias("share")).collect()
    trust = np.ones(model.words.shape)
    for r in found:
        trust[place[r.lang], r.bit] = max(r.share, 1e-3)
    return trust / trust.mean(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row, from its whole text alone.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter
    or nothing was learned; then the score is zero and the answer not ambiguous. The score
    is the winner's share of what is left of all losses. Rows stay as they are, repeats
    included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            answers = predictions(shared.value, batch.column(1).to_pylist())
            yield from in_batches(((i, *a) for i, a in zip(batch.column(0).to_pylist(), answers)), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def predictions(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text."""
    texts = [t or "" for t in texts]
    if not model.languages:
        yield from ((UNKNOWN, 0.0, False) for _ in texts)
        return
    best, top, second = model.decode(model.margins(texts))
    for text, k, p, q in zip(texts, best.tolist(), top.tolist(), second.tolist()):
        if _LETTER.search(text):
            yield model.languages[k], min(1.0, p), q >= AMBIGUOUS_FROM * p
        else:
            yield UNKNOWN, 0.0, False


def identified_documents(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those of unknown language.

    A row goes if its language is ``und``, or if it is ambiguous and no language has
    ``least_score`` for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            answers = predictions(shared.value, batch.column(text_at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and not (unsure and p < least_score) for x, p, unsure in answers]))

    return docs.mapInArrow(run, docs.schema)
