"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm import bpe, counts, discriminant, hamming, licenses, mixing, ngrams, oracle, quality, secrets, shared, tokenfile

WORD_BPE = "word_bpe_49k.json"
#: Wanted shares of tokens by language.
LANGUAGE_SHARES = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_jaccard(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=1)
    return tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every content of the table is a miss once."""
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), shared.fresh_path(spark, "token-counts"), limit=2048)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document is a file in the folder of its language in that of its source."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=10, dimensions=64)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, so that some languages shrink and others grow."""
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, docs.select("doc_id", F.col("lang").alias("domain")), LANGUAGE_SHARES, total=1.0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("chars_distance", "words_distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_ngram_jaccard, op3_secrets, op4_token_output, op5_token_counts, op6_licenses, op7_top_k, op8_quality_classifier, op9_mixing, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": oracle.ngram_jaccard(), "op3_secrets": oracle.secrets(), "op6_licenses": oracle.licenses(), "op7_top_k": oracle.top_k(), "op10_quality_rules": oracle.quality_rules()}
