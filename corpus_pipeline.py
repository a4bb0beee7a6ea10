"""A corpus pipeline over `documents`: language ID, line dedup, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm import lang_id, line_dedup, near_dedup, packing, suffix_dedup
from clademill.llm.common import crc_fold, materialise

#: A document goes if its cosine is below that of this share of the training documents of the language predicted.
LEAST_SHARE = 0.01
#: The cosine of a text with a language it has nothing in common with has a standard deviation of 1 / sqrt(DIMENSION); no bound is below four of them.
CHANCE = 4 / lang_id.DIMENSION**0.5
TOKENIZER = "byte_bpe_50k.json"
OTHERS = ("lang", "source", "n_chars")


def _documents(made: DataFrame) -> DataFrame:
    """The columns of documents from an operator's text and the columns that it carried; n_chars follows the text."""
    return made.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def least_cosines(judged: DataFrame) -> dict[str, float]:
    """The bound of each language, from (lang_pred, cosine, carried.lang) of all training documents that are recognised. To the driver come at most 2,001 counts a language."""
    own = judged.where(F.col("lang_pred") == F.col("carried.lang")).select("lang_pred", F.round("cosine", 3).alias("cosine")).groupBy("lang_pred", "cosine").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, list[tuple[float, int]]] = {}
    for r in own.collect():
        counts.setdefault(r.lang_pred, []).append((r.cosine, r.n))
    out = {}
    for lang, found in counts.items():
        below, total = 0, sum(n for _, n in found)
        for cosine, n in sorted(found):
            below += n
            if below > LEAST_SHARE * total:
                out[lang] = max(CHANCE, cosine - 0.0005)  # the lower end of the rounded value
                break
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language learnt, go. Profiles and bounds come from the documents outside fold 0; a row is judged by its text alone."""
    train = docs.where(crc_fold("doc_id") != 0)
    profiles = lang_id.learn(train)
    least = least_cosines(lang_id.predict(train, profiles, carry=("lang",)))
    judged = lang_id.predict(docs, profiles, carry=OTHERS)
    bound = F.lit(CHANCE)
    for lang, cosine in sorted(least.items()):
        bound = F.when(F.col("lang_pred") == lang, cosine).otherwise(bound)
    kept = judged.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("cosine") >= bound))
    return kept.select("doc_id", "text", "carried.lang", "carried.source", "carried.n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents of which nothing else is left."""
    made = line_dedup.line_dedup(docs, carry=OTHERS)
    return _documents(made.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 0.8 of their five-word shingles, the one with the smallest identifier stays."""
    found = near_dedup.near_dedup(docs, k=5, share=(80, 100))
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", *OTHERS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 words, and of 400 bytes, that begin in several places go, and documents of which those of bytes leave nothing. Where it takes those of words to leave nothing, the row stays, without text. A character that a cut parts goes whole."""
    return _documents(suffix_dedup.suffix_dedup(docs, carry=OTHERS, words="cut").where("not emptied"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the documents of which text is left."""
    return packing.pack_documents(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), public_tokenizers.path(TOKENIZER), added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("suffixes", suffixes),
    ("pack", pack),
]

#: The stages are not for SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
