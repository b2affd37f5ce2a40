"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import align, ann, bpe, html_extract, jaccard, langid, packing, pieces, runs, sharding, substring, topk, toxicity
from gridloom.llm.common import table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2048 words without two of a source or of a cluster of equal texts (but for case)."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    codec = bpe.broadcast_codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode_digests(table(spark, sf_dir, "documents"), codec)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest found of each twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of documents before it."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best candidates of each fiftieth vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.language_of_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two vocabularies meet in every document, and how common its links are among all documents."""
    aligner = align.broadcast_aligner(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), aligner)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text they decode to."""
    codec = pieces.broadcast_codec(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_digests(table(spark, sf_dir, "documents"), codec)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and its text without the repeats."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    found = (op1_html_main_text, op2_best_fit_packing, op3_byte_bpe, op4_nearest_neighbours, op5_substring_dedup, op6_kd_sharding)
    found += (op7_exact_top_k, op8_language_id, op9_toxicity, op10_jaccard_join)
    found += (op11_token_alignment, op12_sentencepiece, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL with the same rows, where SQL can express the query."""
    return {
        "op7_exact_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
            ), r AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
    }
