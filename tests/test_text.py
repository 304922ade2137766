import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from loanfate.operators import text

CARD = "pay credit card debt now"
DETAIL = ("i would like to renovate my kitchen and bathroom this summer the contractor gave a quote and the work "
          "includes plumbing tiles cabinets paint windows lights and a new floor thank you for reading")


@pytest.fixture(scope="module")
def loans(spark):
    draw = random.Random(2)
    rows = []
    for i in range(240):
        if i % 2:
            rows.append((i, "none"))
        else:
            words = (CARD if i % 4 else DETAIL).split()
            draw.shuffle(words)
            rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "loan_id long, desc string").repartition(3).cache()


@pytest.fixture(scope="module")
def clustered(loans):
    return text.cluster_desc(loans, partitions=1).cache()


def test_tokens(spark):
    data = spark.createDataFrame([("Pay-off: 2 Cards, e_mail!",), ("",), ("naïve",)], "desc string")
    assert [r.words for r in text.tokenize_desc(data).collect()] == [["pay", "off", "2", "cards", "e_mail"], [], ["na", "ve"]]


def test_no_description_is_one_cluster(clustered):
    assert clustered.count() == 240
    silent = clustered.filter("no_desc").select("pred_KM").distinct().collect()
    assert len(silent) == 1
    assert clustered.filter("no_desc").count() == 120


def test_names_follow_content(clustered):
    table = {r.label: r for r in text.describe_text_clusters(clustered).collect()}
    assert set(table) == {"No desc.", "Generic desc.", "Detailed desc."}
    assert table["No desc."].no_desc_share == 1.0 or table["No desc."].loans >= 120
    assert table["Generic desc."].mean_words <= table["Detailed desc."].mean_words
    named = text.label_clusters(clustered)
    assert named.count() == 240
    assert {r.pred_KM for r in named.filter("no_desc").select("pred_KM").distinct().collect()} == {"No desc."}


def test_vectors_are_repeatable_with_one_part(loans):
    def vectors():
        rows = text.embed_desc(loans.coalesce(1), partitions=1, method="word2vec").orderBy("loan_id").select("result").collect()
        return [r.result for r in rows]

    assert vectors() == vectors()


def test_words_are_bucketed_the_same_at_every_size(spark, loans):
    """A loan's words do not depend on how many other loans there are."""
    tokens = text.tokenize_desc(loans)
    few, many = tokens.filter("loan_id < 4"), tokens.unionByName(tokens.withColumn("loan_id", F.col("loan_id") + 1000))

    def words(rows):
        return {r.loan_id: r.words for r in text.bucket_words(rows, 50).collect() if r.loan_id < 4}

    assert words(few) == words(many)
    bucketed = text.bucket_words(tokens, 10)
    assert bucketed.select(F.explode("words").alias("w")).distinct().count() <= 10
    assert [r.n for r in bucketed.select(F.size("words").alias("n")).collect()] == [
        r.n for r in tokens.select(F.size("words").alias("n")).collect()]
    assert text.embed_desc(loans, partitions=1, buckets=10, method="word2vec").count() == 240
    assert text.embed_desc(loans, partitions=1, buckets=None, method="word2vec").count() == 240


def test_names_of_more_than_three_clusters_differ(spark):
    rows = [(i, str(i % 5), i % 5 == 0, i % 5) for i in range(50)]
    clustered = spark.createDataFrame(rows, "loan_id long, pred_KM string, no_desc boolean, n_words int")
    labels = {r.label for r in text.describe_text_clusters(clustered).collect()}
    assert labels == {"No desc.", "Generic desc.", "Detailed desc.", "Detailed desc. 2", "Detailed desc. 3"}
    assert text.label_clusters(clustered).select("pred_KM").distinct().count() == 5


def plain_sums(lists, size, buckets):
    """Bucket to (weight, sums): every pair of words of a list, one by one."""
    def code(word, first, digits):
        return int(hashlib.md5(word.encode()).hexdigest()[first - 1:first - 1 + digits], 16)

    out = {}
    for words in lists:
        for i, w in enumerate(words):
            held = out.setdefault(code(w, 17, 4) % buckets, [0] * (size + 1))
            for j, c in enumerate(words):
                if i != j:
                    held[0] += 1
                    for k in range(size):
                        held[1 + k] += 1 - 2 * (code(c, 1, 12) >> k & 1)
    return out


@pytest.mark.parametrize("size, buckets", [(3, 1 << 16), (10, 7)])
def test_vector_sums_equal_all_pairs(spark, size, buckets):
    rng = random.Random(3)
    lists = [[rng.choice(["a", "b", "na\u00efve", "debt", "home", "x1"]) for _ in range(rng.randrange(0, 12))] for _ in range(40)] + [["none"]] * 5
    tokens = spark.createDataFrame([(w,) for w in lists], "words array<string>").repartition(4)
    got = {r.bucket: list(r)[1:] for r in text.word_vector_sums(tokens, size, buckets).collect()}
    assert got == plain_sums(lists, size, buckets)


def test_projection_does_not_depend_on_partitions(loans):
    def vectors(parts):
        return [tuple(round(x, 12) for x in r.result) for r in text.embed_desc(loans.repartition(parts)).orderBy("loan_id").collect()]

    assert vectors(1) == vectors(5)
    table = text.embed_desc(loans)
    assert table.columns == ["loan_id", "n_words", "no_desc", "result"]
    silent = {tuple(r.result) for r in table.filter("no_desc").collect()}
    assert silent == {(0.0,) * 10}  # a word without neighbours has no direction
    assert text.embed_desc(loans.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_neither_kept_nor_shuffled(loans, monkeypatch):
    """Vectors of descriptions are made where the descriptions are: no row per word, no table of words."""
    kept = []
    monkeypatch.setattr(text, "staged", lambda df: kept.append(df.columns) or df)
    table = text.embed_desc(loans)
    assert kept == [] and "Generate" not in plan(table) and "Aggregate" not in plan(table)
    assert table.count() == 240


def test_sums_have_no_row_per_word(loans):
    """The grouping gets one row per bucket and task."""
    assert "Generate" not in plan(text.word_vector_sums(text.tokenize_desc(loans)))


ODD = ["", " ", "naïve Ünïcode", "Kelvin 5K", "İstanbul aİb", "ends_", "_a-B_9", "\U0001f600x\ty\n", "A" * 70, "ßız", "a  b", "x"]


def test_words_are_those_of_the_regex_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(text, "BYTES_AT_ONCE", 16)
    data = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "i int, desc string").repartition(2)
    want = RegexTokenizer(inputCol="desc", outputCol="words", pattern="\\W").transform(data)
    assert sorted(text.tokenize_desc(data).collect()) == sorted(want.collect())
    parts = text.split_words(pa.array([*ODD, None]).slice(2))
    assert parts.to_pylist() == [r.words for r in sorted(want.collect())[2:len(ODD)]] + [[]]


def test_sums_in_small_parts(spark, monkeypatch):
    lists = [["a", "b", "a"], [], ["c"], ["a", "c", "d", "e", "f"], None]
    parts = list(text._word_lists(pa.array(lists, pa.list_(pa.string()))))
    monkeypatch.setattr(text, "WORDS_AT_ONCE", 3)
    small = list(text._word_lists(pa.array(lists, pa.list_(pa.string()))))
    assert len(small) > len(parts) == 1
    assert [n for counts, _ in small for n in counts] == [3, 0, 1, 5, 0]
    assert [w for _, words in small for w in words.to_pylist()] == parts[0][1].to_pylist()


def test_words_stay_in_python(loans):
    """Descriptions are split where their words are used; no list of words goes from Python to Spark and back."""
    assert plan(text.embed_desc(loans)).count("ArrowEvalPython") == 1
    sums = plan(text.word_vector_sums(loans))
    assert "MapInArrow" in sums and "ArrowEvalPython" not in sums


def test_sums_of_texts_equal_those_of_their_words(spark, monkeypatch):
    monkeypatch.setattr(text, "BYTES_AT_ONCE", 16)
    texts = [*ODD * 3, None, "pay debt.  pay-card", "debt", "debt "]
    data = spark.createDataFrame([(t,) for t in texts], "desc string").repartition(2)
    got = {r.bucket: list(r)[1:] for r in text.word_vector_sums(data, 10, 50).collect()}
    assert got == plain_sums(text.split_words(pa.array(texts)).to_pylist(), 10, 50)


def test_vectors_are_means_over_the_words(spark):
    texts = ["pay debt.  pay-card", "", None, "debt ", "naïve Kelvin 5K pay"]
    lists = text.split_words(pa.array(texts)).to_pylist()
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "loan_id long, desc string").repartition(2)
    sums = plain_sums(lists, 3, 1 << 16)
    for r in text.embed_desc(data, size=3).collect():
        held = [sums[int(hashlib.md5(w.encode()).hexdigest()[16:20], 16)] for w in lists[r.loan_id]]
        want = [sum(h[1 + k] / h[0] for h in held if h[0]) / max(1, len(held)) for k in range(3)]
        assert r.n_words == len(held) and list(r.result) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("most", [0, 1, 9, 70000])
def test_several_sums_in_one_number(most):
    rng = np.random.default_rng(most)
    counts = rng.integers(0, most + 1, 12)
    which = rng.integers(0, 5, counts.sum())
    which[::2] = 0
    signs = 1 - 2 * rng.integers(0, 2, (5, 11))
    row = np.repeat(np.arange(12), counts)
    sums = text._sum_signs(signs, which, counts)
    assert [list(s) for s in sums] == [[int(signs[which[row == r], k].sum()) for r in range(12)] for k in range(11)]
    weight = np.bincount(which, counts[row], 5).astype(np.int64)
    by_word = text._sum_by_word(sums, which, counts, weight)
    assert [list(s) for s in by_word] == [[int(s[row[which == w]].sum()) for w in range(5)] for s in sums]
