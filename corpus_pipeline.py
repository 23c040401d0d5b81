"""A corpus pipeline over ``documents``: quality rules, near duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``docs``, whatever their names beside doc_id, text and lang. A stage drops the tables
that the stage before it wrote for itself, as the chain has stored that stage's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm import bpe, mixing, ngrams, quality, secrets, shared
from lakequill.llm.queries import LANGUAGE_SHARES, WORD_BPE


#: Tables that the stages of one chain have written for themselves, by the folder they work on.
_TABLES: dict[str, list[str]] = {}


@contextmanager
def _tables(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """The tables of the chain's earlier stage go, as its result is stored by then; those written inside are noted."""
    mine = _TABLES.setdefault(sf_dir, [])
    shared.drop_paths(spark, mine)
    with shared.scope(mine):
        yield


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go, each by its own text; null and empty texts are rejected, null and repeated ids do not matter."""
    with _tables(spark, sf_dir):
        return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the least id stays, null ids last; rows without words all stay."""
    with _tables(spark, sf_dir):
        return ngrams.deduplicated(docs, k=3, percent=90)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; texts without any, null and empty ones stay as they are."""
    with _tables(spark, sf_dir):
        return secrets.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated as their rates say; no domain shrinks. Null and empty texts have no tokens and the prior's rate."""
    with _tables(spark, sf_dir):
        return mixing.mixed(docs, docs.select("doc_id", F.col("lang").alias("domain")), LANGUAGE_SHARES)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row that is left, as often as it is there; null and empty texts have no ids."""
    with _tables(spark, sf_dir):
        encoded = bpe.encode_documents(docs, public_tokenizers.path(WORD_BPE))
        return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing", mixing_to_weights),
    ("BPE encoding", bpe_encoding),
]

#: SQL can't express the rank array, the soft memberships or the divergence bounds; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the last one's result. What a stage has stored is removed once the next one's result is."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = shared.fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        shared.drop_paths(spark, stored)
        stored.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
