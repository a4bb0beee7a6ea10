"""The queries that apply the operators of this subpackage to the tables they are for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm import bpe, context_mix, exact_dedup, lang_id, line_dedup, media, near_dedup, packing, suffix_dedup, token_counts
from clademill.llm.common import documents

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mix.lm_scores(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), added=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the digest, then whether anything went, how much is left, and the text that is left; last, how many words are in passages of 50 words that begin elsewhere too, which may be shorter than 400 bytes, and whether any."""
    made = suffix_dedup.suffix_dedup(documents(spark, sf_dir), words="count")
    digest = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")]
    return made.select(*digest, (F.col("n_removed") > 0).alias("repeats"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.col("text").alias("kept_text"), F.col("n_words").alias("n_passage_words"), (F.col("n_words") > 0).alias("passages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), k=3, share=(85, 100))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_lm_score, op3_language_id, op4_exact_dedup, op5_packing, op6_token_counts, op7_line_dedup, op8_suffix_dedup, op9_near_dedup, op10_media_columns)}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept, sha256(norm) AS text_sha256
FROM d
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
