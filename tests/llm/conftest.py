import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF_DIR = "/root/testdata/sf0.001"

#: Column names that operators use inside or return, as extra columns of the input.
CLASHES = ["score", "drop", "h", "salt", "fingerprint", "length", "start", "ids"]


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text) pairs, with more columns, some null."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ])

    def make(rows, partitions=3):
        filled = [(i, t, None, None, None if t is None else len(t), *[None] * len(CLASHES)) for i, t in rows]
        return spark.createDataFrame(filled, schema).repartition(partitions)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, odd white space, emoji, combining marks, special-token strings and a very long text."""
    rng = random.Random(5)
    words = ["the", "It's", "naïve", "ÉTÉ", "Σίσυφος", "日本語", "12345", "!!!", "don't", "x" * 90]
    return [
        None, "", " ", "\n\n", "  two  blanks ", "tab\t tab", " lead", "trail ", "a\n b", "a \nb", "é ́x",
        " nbsp   x", "<|endoftext|> and </w>", "\U0001f600 ok\U0001f600", "\x1c\x1d \x1e a", "ΟΔΟΣ ΟΔΟΣ.",
        " ".join(rng.choice(words) for _ in range(30_000)), "y" * 70_000, "a" + " " * 5_000 + "b",
    ]
