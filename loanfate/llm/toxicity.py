"""Toxicity by class-conditional interpolated Kneser-Ney models of three words.

For the toxic and the ordinary class, runs of up to three words are counted: raw counts for three
words, Kneser-Ney continuation counts (different words that a run follows) for two and one. Each
order is discounted and interpolated with the next shorter one; below single words both classes back
off to the same shared distribution, that of the words in all texts, labelled or not. A text's
log-likelihoods under both models are compared per word, for its strongest expression (the run of
up to three words whose discounted counts tell most) and for the whole text, evidence for either class
alike, and a logistic curve fitted on training rows that its counts have not seen makes a score of the two.

The difference of a text's log-likelihoods is a sum of one weight for each of its runs (as in a
back-off table: an unseen run adds nothing and leaves the word to the shorter runs). The classifier
learns from a bounded number of labelled rows (``most_rows``), so its table of runs is bounded: it is
a sorted array that every task gets, and texts are scored in one pass without a shuffle. The shared
backoff counts are taken over the whole corpus and grow with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import discard, slices, stored, text_or_empty, text_slices

#: About how many labelled rows the classifier learns from, those whose ids draw lowest; fewer if fewer are labelled.
MOST_ROWS = 3000
#: Runs that a model may have. Each takes 16 bytes in every Python worker; a longer table raises an error.
MOST_RUNS = 12_000_000
#: Hashes that stand for what is before a text's first word and after its last.
BEFORE_TEXT, AFTER_TEXT = 0x243F6A8885A308D3, 0x13198A2E03707344
#: Taken off each class's count.
DISCOUNT = 0.75
#: Shared backoff count of every word.
BACKOFF = 2.0
#: One in so many training rows fits the curve, by counts without them; then they are counted too.
CURVE_FOLDS = 4
#: Steps of the features of the curve, and the features' range.
STEP, REACH = 0.125, 10.0
#: Score from which a text is predicted toxic.
THRESHOLD = 0.7
#: Characters of texts that are scored at a time.
TEXT_CHARS = 500_000
#: Words remembered by a Python worker; then it starts anew.
REMEMBERED_WORDS = 100_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same for texts below U+0300, by the standard library, whose tables are faster there.
_NEAR_WORD = re.compile("[%s]+" % "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] in "LMN"))
_FAR = re.compile("[^\x00-\u02ff]")


def words_of(text: str) -> list[str]:
    """Runs of letters, marks and digits in lower case."""
    lower = text.lower()
    return (_WORD if _FAR.search(lower) else _NEAR_WORD).findall(lower)


def long_hash(word: str) -> int:
    value = xxhash.xxh64_intdigest(word.encode())
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Model:
    """Runs by their ids, ascending, with their weights and ratios, and the curve's weights of one, strongest and mean."""

    runs: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray
    curve: np.ndarray

    def features(self, texts: list[str], known: dict[str, int]) -> np.ndarray:
        """(texts, 2): the strongest expression's ratio and the mean log-likelihood ratio per word.

        Both are zero for a text without a word. ``known`` remembers words between calls.
        """
        out = np.zeros((len(texts), 2))
        hashed = [_hashes(t, known) for t in texts]
        some = [k for k, h in enumerate(hashed) if len(h)]
        if not some or not len(self.runs):
            return out
        ids = [_run_ids(hashed[k]) for k in some]
        begins = np.cumsum([0, *map(len, ids[:-1])])
        each, place = np.unique(np.concatenate(ids), return_inverse=True)
        at = np.minimum(np.searchsorted(self.runs, each), len(self.runs) - 1)
        met = self.runs[at] == each
        weights, ratios = (np.where(met, x[at], 0)[place].astype(np.float64) for x in (self.weights, self.ratios))
        words = np.array([len(hashed[k]) - 2 for k in some])
        out[some, 0] = np.maximum.reduceat(ratios, begins)
        out[some, 1] = np.add.reduceat(weights, begins) / words
        return np.clip(out, -REACH, REACH)

    def scores(self, texts: list[str], known: dict[str, int]) -> np.ndarray:
        x = self.features(texts, known)
        z = self.curve[0] + np.maximum(x[:, 0], 0) * self.curve[1] + x[:, 1] * self.curve[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(fold: int = 1, folds: int = 3) -> Column:
    """Whether the CRC-32 of the id as text falls into the held-out fold; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def labelled(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, most_rows: int = MOST_ROWS) -> DataFrame:
    """(text, toxic, for_curve) of the training rows: labelled 0 or 1, not of the held-out fold.

    Beyond ``most_rows`` of them, about so many are taken: those whose ids have the lowest hashes. An
    id labelled more than once has its greatest label. Both sides lose the held-out rows before
    they meet, by a sort-merge join at every size: neither side has a bound.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isin(0, 1) & ~held_out(fold, folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > most_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * (most_rows / n)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull() & ~held_out(fold, folds))
    for_curve = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CURVE_FOLDS)) == 0
    return texts.join(marks.hint("merge"), "doc_id").select("text", "toxic", for_curve.alias("for_curve"))


def _hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """Hashes of the text's words between the marks before and after it; nothing if it has no word."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = long_hash(w)
    return np.array([BEFORE_TEXT, BEFORE_TEXT, *map(known.__getitem__, words), AFTER_TEXT], np.int64)


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(u, v, w, t0, o0, t1, o1): occurrences of each run of three words in toxic and ordinary rows.

    ``t0`` and ``o0`` are of the rows that are not ``for_curve``, ``t1`` and ``o1`` of the others.
    A task sends a run once for about a million words.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("u", "v", "w")), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            all_runs = np.concatenate(held, axis=1)
            order = np.lexsort(all_runs)
            all_runs = all_runs[:, order]
            starts = np.flatnonzero(np.r_[True, (all_runs[:, 1:] != all_runs[:, :-1]).any(axis=0)])
            n = np.diff(np.r_[starts, all_runs.shape[1]])
            for k in range(0, len(starts), 100_000):
                u, v, w, kind = all_runs[:, starts[k:k + 100_000]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (u, v, w)), pa.array(kind.astype(np.int32)), pa.array(n[k:k + 100_000])], schema=schema
                )

        for batch in slices(batches, 512):
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _hashes(text, known)
                if len(h):
                    held.append(np.array([h[:-2], h[1:-1], h[2:], np.full(len(h) - 2, kind, np.int64)]))
                    size += len(h)
                if size > 1_000_000:
                    yield from counted()
                    held, size = [], 0
        yield from counted()

    kind = F.col("toxic") + 2 * F.col("for_curve").cast("int")
    counted = rows.select(kind.alias("kind"), "text").mapInArrow(run, "u long, v long, w long, kind int, n long")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for c, k in (("t0", 1), ("o0", 0), ("t1", 3), ("o1", 2))]
    return counted.groupBy("u", "v", "w").agg(*sums)


def _turned(column: str, by: int) -> Column:
    return F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by))


def _run_ids(h: np.ndarray) -> np.ndarray:
    """Ids of all runs of a text of hashes: as in :func:`run_weights`, each occurrence once."""
    x = h.view(np.uint64)

    def turned(y: np.ndarray, by: int) -> np.ndarray:
        return y << np.uint64(by) | y >> np.uint64(64 - by)

    two = turned(x[:-1], 13) ^ x[1:]
    three = turned(x[:-2], 21) ^ turned(x[1:-1], 42) ^ x[2:]
    # The first mark is only what stands before the second one.
    return np.concatenate([x[1:], two, three]).view(np.int64)


def corpus_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(w, n): occurrences of the given words (hashes, ascending) in all texts, the mark after a text included.

    One pass over the corpus; a task sends one row per word that it met.
    """
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64())])
    asked = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = asked.value, {}
        counts = np.zeros(len(words), np.int64)
        for batch in slices(batches, 512):
            hashed = [h[2:] for h in (_hashes(t, known) for t in batch.column(0).to_pylist()) if len(h)]
            if hashed:
                each, n = np.unique(np.concatenate(hashed), return_counts=True)
                at = np.minimum(np.searchsorted(words, each), len(words) - 1)
                met = words[at] == each
                counts[at[met]] += n[met]
        found = np.flatnonzero(counts)
        for k in range(0, len(found), 100_000):
            part = found[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(words[part]), pa.array(counts[part])], schema=schema)

    texts = docs.select(text_or_empty().alias("text"))
    return texts.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def run_weights(trigrams: DataFrame, corpus: DataFrame) -> DataFrame:
    """(run, weight, ratio) of all runs of up to three words in a table (u, v, w, t, o) of counts.

    Summed over a text's runs, ``weight`` is log P(text | toxic) / P(text | ordinary) by interpolated
    Kneser-Ney: that of a run of n words is its last word's log-ratio after the others, less
    what the runs within it add, and the log-ratio of the back-off mass behind it. ``ratio`` compares
    the discounted counts of the run in both classes, with the shared backoff; a run seen once
    tells little. ``corpus`` (w, n) has the words' counts in all texts, one for a word that it lacks.
    A class without words gives no run.
    """
    three = trigrams.filter("t + o > 0")
    two = stored(three.groupBy("v", "w").agg(*_kinds()), "bigrams")
    one_stored = stored(two.groupBy("w").agg(*_kinds()), "words")
    one = one_stored.join(corpus, "w", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"k{c}") for c in "to"]
    sizes = one.agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("n").alias("n"), *kinds).first()
    if not sizes.t or not sizes.o:
        return trigrams.select(F.col("w").alias("run"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("ratio")).limit(0)

    def share(c: str, totals) -> float:
        return totals[c] / (totals.t + totals.o)

    def telling(totals) -> Column:
        t, o = (F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + BACKOFF * share(c, totals)) / share(c, totals)) for c in "to")
        return t - o

    def behind(table: DataFrame, by: list[str]) -> DataFrame:
        """Counts of what follows a run, the back-off mass left by class, and the masses' log-ratio."""
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"k{c}") for c in "to"]
        sums = table.groupBy(*by).agg(*[F.sum(c).alias(f"c{c}") for c in "to"], *kinds)
        masses = [F.when(F.col(f"c{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"c{c}")).otherwise(1.0).alias(f"m{c}") for c in "to"]
        return sums.select(*by, "ct", "co", *masses).withColumn("left", F.log(F.col("mt") / F.col("mo")))

    def mixed(c: str) -> Column:
        own = F.when(F.col(f"c{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"c{c}")).otherwise(0.0)
        return own + F.col(f"m{c}") * F.col(f"p{c}")

    shared = F.col("n") / F.lit(float(sizes.n))
    words = one.select("w", telling(sizes).alias("ratio"), *[
        ((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * sizes[f"k{c}"] * shared) / sizes[c]).alias(f"p{c}") for c in "to"
    ])
    after_one = stored(behind(two, ["v"]), "behind-words")
    pairs_total = two.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    joined = two.join(after_one.hint("merge"), "v").join(words.drop("ratio").hint("merge"), "w")
    inner = F.log(F.col("pt") / F.col("po"))
    pairs = stored(joined.select(
        "v", "w", telling(pairs_total).alias("ratio"), mixed("t").alias("pt"), mixed("o").alias("po"),
        (F.log(mixed("t") / mixed("o")) - F.col("left") - inner).alias("own"),
    ), "bigram-models")
    after_two = stored(behind(three, ["u", "v"]), "behind-bigrams")
    runs_total = three.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    joined = three.join(after_two.hint("merge"), ["u", "v"]).join(pairs.select("v", "w", "pt", "po").hint("merge"), ["v", "w"])
    third = joined.select(
        _turned("u", 21).bitwiseXOR(_turned("v", 42)).bitwiseXOR(F.col("w")).alias("run"),
        (F.log(mixed("t") / mixed("o")) - F.col("left") - inner).alias("weight"), telling(runs_total).alias("ratio"),
    )
    second = pairs.select(_turned("v", 13).bitwiseXOR(F.col("w")).alias("run"), F.col("own").alias("weight"), "ratio")
    first = words.select(F.col("w").alias("run"), inner.alias("weight"), "ratio")
    left = after_one.select(F.col("v").alias("run"), F.col("left").alias("weight"), F.lit(0.0).alias("ratio")).unionByName(
        after_two.select(_turned("u", 13).bitwiseXOR(F.col("v")).alias("run"), F.col("left").alias("weight"), F.lit(0.0).alias("ratio"))
    )
    shorter = first.unionByName(second).unionByName(left).groupBy("run").agg(F.sum("weight").alias("weight"), F.sum("ratio").alias("ratio"))
    found = stored(shorter.unionByName(third), "run-weights")
    discard(two, one_stored, after_one, pairs, after_two)
    return found


def _kinds() -> list[Column]:
    return [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in "to"]


def packed(weights: DataFrame, curve: np.ndarray) -> Model:
    """The table of :func:`run_weights` as arrays in the driver, whose size is checked first."""
    n = weights.count()
    if n > MOST_RUNS:
        raise ValueError(f"a model of {n} runs is over {MOST_RUNS}; learn from fewer rows (most_rows)")
    # Sorted by the tasks, so that the driver holds one copy.
    ordered = weights.select("run", F.col("weight").cast("float").alias("weight"), F.col("ratio").cast("float").alias("ratio")).orderBy("run")
    table = ordered.toArrow()
    return Model(*(table.column(c).to_numpy() for c in ("run", "weight", "ratio")), curve)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, most_rows: int = MOST_ROWS) -> Model:
    """Fit the curve by counts without its rows, then count all training rows for the model.

    The training rows are those of :func:`labelled`; the shared backoff counts are over all of
    ``docs``. What reaches the driver is bounded by ``most_rows``: the words and runs of the training
    rows, and the curve's rows as counts of cells of their features. Without rows of both classes
    every score is the share of toxic ones, zero if there is none.
    """
    spark = docs.sparkSession
    rows = stored(labelled(docs, labels, fold, folds, most_rows), "training-rows")
    counts = stored(trigram_counts(rows), "trigram-counts")
    words = np.sort(counts.select("w").distinct().toArrow().column("w").to_numpy())
    if not len(words):
        discard(counts)
        return packed(spark.createDataFrame([], "run long, weight double, ratio double"), fit_curve(np.empty((0, 2)), *np.empty((2, 0), int)))
    corpus = stored(corpus_counts(docs, words), "corpus-counts")
    weights = run_weights(counts.select("u", "v", "w", F.col("t0").alias("t"), F.col("o0").alias("o")), corpus)
    held = spark.sparkContext.broadcast(packed(weights, np.zeros(3)))
    discard(weights)
    schema = pa.schema([("toxic", pa.int32()), ("strongest", pa.int32()), ("mean", pa.int32())])

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, 256):
            x = held.value.features(batch.column(1).to_pylist(), known)
            x[:, 0] = np.maximum(x[:, 0], 0)
            cell = np.round(x / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(cell[:, 0]), pa.array(cell[:, 1])], schema=schema)

    found = rows.filter("for_curve").select("toxic", "text").mapInArrow(cells, "toxic int, strongest int, mean int")
    table = found.groupBy("toxic", "strongest", "mean").agg(F.count("*").alias("n")).toArrow()
    held.destroy()
    x = np.column_stack([table.column(c).to_numpy() * STEP for c in ("strongest", "mean")])
    curve = fit_curve(x, table.column("toxic").to_numpy(), table.column("n").to_numpy())
    weights = run_weights(counts.select("u", "v", "w", (F.col("t0") + F.col("t1")).alias("t"), (F.col("o0") + F.col("o1")).alias("o")), corpus)
    model = packed(weights, curve)
    discard(rows, counts, corpus, weights)
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression of cells (x, y) with ``n`` rows each by Newton's method, slopes held by a ridge."""
    if not len(y) or y.min() == y.max():
        rate = float(y.max()) if len(y) else 0.0
        return np.array([30.0 if rate else -30.0, 0.0, 0.0])
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    hold = np.diag([1e-6, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (n * (y - p)) - hold @ w
        curve = (a * (n * p * (1 - p))[:, None]).T @ a + hold
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5.0 / max(5.0, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row from its whole text; null and empty texts score as texts without a word.

    One pass without a shuffle; the model is broadcast, its size bounded by :data:`MOST_RUNS`. Very
    long texts are scored whole, a few texts at a time. Repeated rows score alike, as do equal
    texts; ties don't arise. A null doc_id is kept. No rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in text_slices(texts, TEXT_CHARS):
                score = held.value.scores(texts[start:end], known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(score)], schema=schema)

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return asked.mapInArrow(run, "doc_id long, score double")


def ordinary_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold; see :func:`score_texts`."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for start, end in text_slices(texts, TEXT_CHARS):
                score = held.value.scores(texts[start:end], known)
                yield batch.slice(start, end - start).filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
