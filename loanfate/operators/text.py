"""Clusters of loan descriptions."""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanfate.sources import shuffles_freed, staged

# The names of the description clusters.
NO_DESC, GENERIC_DESC, DETAILED_DESC = "No desc.", "Generic desc.", "Detailed desc."

#: Hash buckets of words, and parts on which word vectors are trained by ``word2vec``.
BUCKETS, PARTITIONS = 1 << 16, 8
#: Bytes of text split, and words whose vectors are added, at a time; they bound a task's memory only.
BYTES_AT_ONCE, WORDS_AT_ONCE = 1 << 23, 1 << 21

_GAPS = b" "
_GAP = _GAPS[0]
_WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or chr(b) == "_") else _GAP for b in range(256))
# The only letters beyond ASCII whose lower case has an ASCII letter: the Kelvin sign and I with a dot (i and a mark).
_ASCII_LOWER = {"\u212a": "k", "\u0130": "i "}


def _row_parts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` units each, by the rows' offsets; a larger row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def _text_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, bytes]:
    """Where each text begins in the bytes of all, and those."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return offsets - offsets[0], bytes(memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]])


def _word_starts(texts: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins in the bytes of all, those with words in lower case and gaps else, where words begin,
    and whether a byte is of a word, and goes on with the word of the byte before."""
    offsets, held = _text_bytes(texts)
    for capital, lower in _ASCII_LOWER.items():
        if capital.encode() in held:
            texts = pc.replace_substring(texts, capital, lower)
            offsets, held = _text_bytes(texts)
    held = held.translate(_WORD_BYTES)
    data = np.frombuffer(held, np.uint8)
    inside = np.zeros(len(data) + 1, bool)
    np.not_equal(data, _GAP, out=inside[:-1])
    joined = np.zeros(len(data) + 1, bool)
    np.logical_and(inside[:-1], inside[1:], out=joined[1:])
    joined[offsets] = False
    return offsets, held, np.flatnonzero(inside > joined), inside, joined


def _split_part(texts: pa.Array) -> pa.Array:
    """The words of some texts, by whole-array operations on their bytes."""
    offsets, held, starts, inside, joined = _word_starts(texts)
    ends = np.flatnonzero(inside[:-1] > joined[1:]) + 1
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = np.frombuffer(held, np.uint8)[inside[:-1]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), words)


def _text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Some texts at a time, by their bytes; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    for i, j in _row_parts(offsets, BYTES_AT_ONCE):
        yield texts.slice(i, j - i)


def _words_in_place(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Some texts at a time: the number of words of each, and all their words, each with the gaps that follow it.

    The words are those of :func:`split_words`, left where they stand in the bytes of the texts.
    """
    for part in _text_parts(texts):
        offsets, held, starts, *_ = _word_starts(part)
        ends_at = np.append(starts, len(held)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(held))
        yield np.diff(np.searchsorted(starts, offsets)), words


def split_words(texts: pa.Array) -> pa.Array:
    """Lower-case words of each text: runs of letters A-Z, digits and _. A null text has none."""
    parts = [_split_part(part) for part in _text_parts(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def tokenize_desc(loans: DataFrame) -> DataFrame:
    """Add ``words``, the lower-case words of the cleaned description, split at anything but letters, digits and _.

    They are those of RegexTokenizer with the pattern ``\\W``, found for a batch of texts at a time (:func:`split_words`).
    """
    return loans.withColumn("words", F.arrow_udf(split_words, "array<string>")("desc"))


def bucket_words(tokens: DataFrame, buckets: int) -> DataFrame:
    """Replace every word by one of ``buckets`` hash buckets, whatever other rows there are."""
    hashed = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("string"))
    return tokens.withColumn("words", hashed)


def _coded_words(words: pa.Array, size: int, buckets: int, gaps: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word among the different ones, and the bucket and signs of those, from their md5.

    Words that end in ``gaps`` are told apart by them, but coded without.
    """
    coded = words.dictionary_encode()
    offsets, held = _text_bytes(coded.dictionary.cast(pa.large_string()))
    ends = offsets.tolist()
    plain = (held[i:j] for i, j in zip(ends, ends[1:]))
    if gaps:
        plain = (word.rstrip(gaps) for word in plain)
    digests = b"".join([hashlib.md5(word, usedforsecurity=False).digest() for word in plain])
    digest = np.frombuffer(digests, np.uint8).reshape(-1, 16).astype(np.int64)
    code = sum(digest[:, k] << 8 * (5 - k) for k in range(6))
    bucket = (digest[:, 8] << 8 | digest[:, 9]) % buckets
    signs = 1 - 2 * (code[:, None] >> np.arange(size) & 1)
    return coded.indices.to_numpy().astype(np.intp), bucket, signs


def _word_lists(lists: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Some rows at a time of a column of word lists: the number of words of each, and all their words."""
    lists = pc.fill_null(lists, [])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    for i, j in _row_parts(offsets, WORDS_AT_ONCE):
        yield np.diff(offsets[i:j + 1]), lists.values.slice(offsets[i], offsets[j] - offsets[i])


def _sum_rows(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many of them each; zero for none."""
    sums = np.zeros(len(counts), values.dtype)
    filled = counts > 0
    if filled.any():
        sums[filled] = np.add.reduceat(values, (np.cumsum(counts) - counts)[filled])
    return sums


def _sum_signs(signs: np.ndarray, which: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each sign, its sum over the words of every row; several are counted at once, as fields of one whole number."""
    size, most = signs.shape[1], int(counts.max(initial=0))
    width = max(1, most.bit_length())
    sums, fields = [], 63 // width
    held = np.empty(len(which), np.int64)
    for k in range(0, size, fields):
        among = range(k, min(size, k + fields))
        negative = sum((signs[:, j] < 0).astype(np.int64) << width * (j - k) for j in among)
        # With clip no copy of the numbers is checked first; all are in range.
        found = _sum_rows(negative.take(which, out=held, mode="clip"), counts)
        sums += [counts - 2 * (found >> width * (j - k) & (1 << width) - 1) for j in among]
    return sums


def _sum_by_word(of_rows: list[np.ndarray], which: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """Each row value's sum over the places of every word, several at once; ``weight`` bounds the sums' size by word."""
    width = int(weight.max(initial=0)).bit_length() + 1
    fields, half = max(1, 63 // width), 1 << width - 1
    for k in range(0, len(of_rows), fields):
        among = of_rows[k:k + fields]
        held = np.zeros(len(weight), np.int64)
        np.add.at(held, which, np.repeat(sum(v << width * j for j, v in enumerate(among)), counts))
        for _ in among:
            # The lowest field, with its sign; the rest is a multiple of the field's size.
            own = (held + half & 2 * half - 1) - half
            yield own
            held = held - own >> width


def word_vector_sums(tokens: DataFrame, size: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight, v0, v1, ...): sums over the neighbours of each word, by hash bucket of the word.

    Takes the column ``words``, or else ``desc``, cleaned descriptions, whose words it makes as
    :func:`tokenize_desc` does; they then stay where they are added up.

    Every word has a fixed vector of ``size`` signs, bits of its md5. A word's neighbours are the
    other words of its description; their signs add to its sums, their number to its weight. All
    are whole numbers, so the sums are the same however the rows are split and ordered. A task
    adds up its batches of descriptions in one array and sends one row per bucket, a hot word
    included; a word is hashed once per batch.
    """
    if not 0 < size <= 48 or not 0 < buckets <= 1 << 16:
        raise ValueError("at most 48 signs and 65,536 buckets")
    names = ["bucket", "n", "weight", *[f"v{k}" for k in range(size)]]
    column, parts_of, gaps = ("words", _word_lists, b"") if "words" in tokens.columns else ("desc", _words_in_place, _GAPS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 + size, buckets), np.int64)
        for batch in batches:
            for counts, words in parts_of(batch.column(0)):
                which, bucket, signs = _coded_words(words, size, buckets, gaps)
                n = np.bincount(which, minlength=len(bucket))

                def add(at: int, of_word: np.ndarray) -> None:
                    # A part's sums are whole numbers below 2^53, so the doubles are exact.
                    held[at] += np.bincount(bucket, of_word, buckets).astype(np.int64)

                add(0, n)
                weight = np.bincount(which, np.repeat(counts, counts), len(bucket)).astype(np.int64)
                add(1, weight - n)
                sums = _sum_by_word(_sum_signs(signs, which, counts), which, counts, weight)
                for k, of_word in enumerate(sums):
                    add(2 + k, of_word - n * signs[:, k])
        met = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(met), *map(pa.array, held[:, met])], names=names)

    parts = tokens.select(column).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(*[F.sum(c).alias(c) for c in names[2:]])


def _project(loans: DataFrame, size: int, buckets: int) -> DataFrame:
    """Add ``n_words`` and ``result``: the mean over a description's words of their sums per neighbour; zeros where there are none.

    The table of at most ``buckets`` rows of ``size`` numbers goes to every task. The words are made
    once for it and once here, and neither they nor their vectors are written, shuffled or handed from Python to Spark.
    """
    with shuffles_freed(loans.sparkSession):
        table = word_vector_sums(loans.select("desc"), size, buckets).filter("weight > 0").toArrow()
    vectors = np.zeros((size, buckets))
    for k in range(size):
        vectors[k, table.column("bucket").to_numpy()] = table.column(f"v{k}").to_numpy() / table.column("weight").to_numpy()
    shared = loans.sparkSession.sparkContext.broadcast(vectors)

    def means(texts: pa.Array) -> pa.Array:
        lengths, found = [np.empty(0, np.int64)], [np.empty((0, size))]
        for counts, words in _words_in_place(texts):
            which, bucket, _ = _coded_words(words, size, buckets, _GAPS)
            held = np.empty(len(which))
            sums = [_sum_rows(v[bucket].take(which, out=held, mode="clip"), counts) for v in shared.value]
            lengths.append(counts)
            found.append(np.stack(sums, axis=1) / np.maximum(counts, 1)[:, None])
        rows = np.concatenate(found)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
        vector = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(lengths).astype(np.int32)), vector], ["n_words", "result"])

    made = F.arrow_udf(means, "n_words int, result array<double>")("desc")
    return loans.withColumns({"_made": made, "no_desc": F.col("desc") == "none"}).select(
        *[c for c in loans.columns if c != "desc"],
        F.col("_made.n_words").alias("n_words"), "no_desc", array_to_vector("_made.result").alias("result"),
    )


def embed_desc(
    loans: DataFrame,
    size: int = 10,
    seed: int = 1,
    partitions: int = PARTITIONS,
    buckets: int | None = BUCKETS,
    method: str = "projection",
) -> DataFrame:
    """Replace the description by ``result``, the mean of its word vectors.

    Also adds ``n_words`` and ``no_desc``, what the naming of clusters needs to know about
    the text.

    ``projection`` sums the signs of a word's neighbours (:func:`word_vector_sums`): one pass,
    no training, no vocabulary in the driver, and the same vectors for any number of partitions. A second
    pass splits the descriptions again, which takes less than to keep all their words.
    ``word2vec`` trains vectors with MLlib, which holds its vocabulary in the driver and in
    every task. Words are then mapped to ``buckets`` hash buckets, so that no word is left out
    and the vocabulary is bounded; ``None`` keeps plain words, for text whose vocabulary is known to
    be small. Training runs on ``partitions`` parts of the text at a time and merges what they
    learned, so the number is part of the model and does not follow the cluster's size.
    """
    if method == "projection":
        return _project(loans, size, buckets or BUCKETS)
    if method != "word2vec":
        raise ValueError(f"method must be 'projection' or 'word2vec', got {method!r}")
    tokens = tokenize_desc(loans).withColumns({"n_words": F.size("words"), "no_desc": F.col("desc") == "none"})
    tokens = staged((tokens if buckets is None else bucket_words(tokens, buckets)).drop("desc"))
    word2vec = Word2Vec(
        vectorSize=size, minCount=0, seed=seed, numPartitions=partitions, inputCol="words", outputCol="result"
    )
    return word2vec.fit(tokens.select("words")).transform(tokens).drop("words")


def cluster_desc(loans: DataFrame, k: int = 3, seed: int = 1, **embedding) -> DataFrame:
    """Replace the description by ``pred_KM``, its cluster, as text.

    Loans without a description share one vector and so one cluster. The vectors are
    staged: the rounds of the clustering and every later use read ten numbers per loan
    instead of its text.
    """
    embedded = staged(embed_desc(loans, seed=seed, **embedding))
    kmeans = KMeans(k=k, seed=seed, featuresCol="result", predictionCol="pred_KM")
    clustered = kmeans.fit(embedded.select("result")).transform(embedded)
    return clustered.withColumn("pred_KM", F.col("pred_KM").cast("string")).drop("result")


def describe_text_clusters(clustered: DataFrame) -> DataFrame:
    """One row per cluster: loans, share without description, mean words, and its name.

    Cluster numbers mean nothing, so names follow the content: the cluster with the
    largest share of missing descriptions, then the one with the shortest texts, then
    the rest, numbered from the second of them on. The ordering window sees one row per
    cluster.
    """
    clusters = clustered.groupBy("pred_KM").agg(
        F.count("*").alias("loans"),
        F.avg(F.col("no_desc").cast("double")).alias("no_desc_share"),
        F.avg("n_words").alias("mean_words"),
    )
    rank = F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("no_desc_share").desc(), "mean_words", "pred_KM")
    )
    further = F.concat(F.lit(f"{DETAILED_DESC} "), (rank - 2).cast("string"))
    label = F.when(rank == 1, NO_DESC).when(rank == 2, GENERIC_DESC).when(rank == 3, DETAILED_DESC).otherwise(further)
    return clusters.withColumn("label", label)


def label_clusters(clustered: DataFrame) -> DataFrame:
    """Replace cluster numbers by cluster names; one row per cluster is broadcast."""
    names = describe_text_clusters(clustered).select("pred_KM", "label")
    return clustered.join(F.broadcast(names), "pred_KM").drop("pred_KM").withColumnRenamed("label", "pred_KM")
