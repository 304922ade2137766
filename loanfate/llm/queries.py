"""The corpus operators as named queries over the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanfate.llm import (
    bpe, edit_embedding, fill_middle, language, licenses, line_dedup, packing, simhash, spelling, substring,
    token_files, topk, toxicity,
)
from loanfate.llm.common import read_documents, scratch_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next one's are."""
    return edit_embedding.compare_with_next(read_documents(spark, sf_dir))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 greatest integer inner products of every fiftieth vector with all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = topk.usable(rows, "vec_id", "embedding").select("vec_id", "v")
    scaled = finite.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    vectors = topk.usable(scaled, "vec_id", "v")
    found = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = read_documents(spark, sf_dir)
    found = language.identify(docs, language.learn(docs, fold=0, folds=5))
    held_out = F.coalesce(language.held_out(0, 5), F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest doc_id of its class of near-duplicates."""
    found = simhash.near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to bit-plane files and read back, as start, length and checksum."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    back = token_files.read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence texts in every document."""
    return licenses.summarise(licenses.scan_documents(read_documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is toxic, learned from the labelled ones outside the held-out fold."""
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score_texts(docs, toxicity.fit(docs, labels, fold=1, folds=3))
    held_out = F.coalesce(toxicity.held_out(1, 3), F.lit(True))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 ids."""
    docs = read_documents(spark, sf_dir)
    return packing.with_checksums(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines that it loses to others, and a digest of the text that stays."""
    kept = line_dedup.dedup_lines(read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it, as digests."""
    found = fill_middle.fill_in_middle(read_documents(spark, sf_dir), seed=7, rate=100, spm_rate=50)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored().cast("binary"), 256).alias("restored_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words that repeated windows of 35 words cover, and a digest of the rest."""
    kept = substring.drop_repeated_words(read_documents(spark, sf_dir), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, the form that each varies, and the root of its forms."""
    return spelling.spelling_variants(read_documents(spark, sf_dir))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_edit_embedding": op2_edit_embedding,
    "op3_top_k": op3_top_k,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling": op13_spelling,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op3_top_k": """
        WITH usable AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op10_line_dedup": f"""
        WITH parts AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM parts
        ), keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, line, pos, (c.key IS NOT NULL AND doc_id <> keeper) AS lost
            FROM keyed k LEFT JOIN common c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_fill_middle": """
        WITH given AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
        ), drawn AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS parts,
                ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
                ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
            FROM given
        ), counted AS (
            SELECT *, len(parts) - (CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END) AS n FROM drawn
        ), cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                    THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM counted
        ), ended AS (
            SELECT *,
                CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS up_to_a,
                CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS up_to_b
            FROM cut
        ), pieces AS (
            SELECT *, substr(up_to_b, length(up_to_a) + 1) AS middle, substr(text, length(up_to_b) + 1) AS suffix FROM ended
        )
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN length(up_to_a) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || up_to_a || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || up_to_a || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM pieces
    """,
    "op12_substring_dedup": """
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, words, unnest(range(len(words) - 34)) AS first FROM split WHERE len(words) >= 35
        ), named AS (
            SELECT doc_id, first, sha256(array_to_string(words[first + 1:first + 35], ' ')) AS name FROM windows
        ), repeated AS (
            SELECT name FROM named GROUP BY name HAVING count(*) > 1
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(first, first + 35)) AS pos FROM named JOIN repeated USING (name)
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split
        ), left_over AS (
            SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept
            FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id
        )
        SELECT s.doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM split s LEFT JOIN left_over l ON s.doc_id = l.doc_id
    """,
}
