"""The pipeline's stages on their own inputs, and as a whole against the operators one by one."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loanfate.llm import language, line_dedup, toxicity
from loanfate.llm.common import read_documents

from .test_simhash import plain_jaccard_classes

SF_DIR = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert list(STAGES) == ["toxicity", "language", "lines", "near-duplicates", "packing"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_return_the_columns_they_got(spark, documents, odd_texts, name):
    docs = documents([*enumerate(odd_texts), (3, "again words"), (3, "again words"), (None, "no id, but words")])
    kept = STAGES[name](spark, docs, SF_DIR)
    assert kept.schema.names == docs.schema.names
    assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert kept.count() <= docs.count()
    assert STAGES[name](spark, docs.limit(0), SF_DIR).count() == 0


def test_packing_of_no_documents(spark, documents):
    assert STAGES["packing"](spark, documents([]), SF_DIR).count() == 0


def test_run_equals_plain_stages(spark):
    docs = read_documents(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = toxicity.score_texts(docs, toxicity.fit(docs, labels)).filter("score < 0.7").select("doc_id")
    left = docs.join(scores, "doc_id")
    answers = language.identify(left, language.learn(left)).filter("lang_pred <> 'und' AND NOT (ambiguous AND score < 0.5)")
    left = left.join(answers.select("doc_id"), "doc_id")
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(left).collect()}
    # Groups of similar texts by comparing all shingle sets with each other.
    ids = sorted(texts)
    label = plain_jaccard_classes([texts[i] for i in ids])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {ids[k]: [*tokenizer.encode(texts[ids[k]], add_special_tokens=False).ids, 1] for k in sorted(set(label))}
    got = defaultdict(list)
    lengths = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        got[r.doc_id].append((r.start, r.length, zlib.crc32(r.ids)))
        lengths[r.sequence_id] += r.length
    assert set(got) == set(want) and max(lengths.values()) <= 2048
    for i, pieces in got.items():
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and crc == zlib.crc32(np.array(want[i][at:at + length], "<u4").tobytes())
            at += length
        assert at == len(want[i])
