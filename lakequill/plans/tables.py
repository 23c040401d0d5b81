"""The benchmark tables as relations of an engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakequill.plans.engine import Engine
from lakequill.sources.registry import Registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that knows every table of the folder; a table is opened when a query names it."""
    registry = Registry(spark)
    for name in TABLES:
        registry.register_source(name, "parquet", f"{sf_dir}/{name}.parquet")
    return Engine(spark, registry)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the warehouse, which every executor sees."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lakequill_scratch/{uuid.uuid4().hex}/{name}"


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return engine(spark, sf_dir).sql(text)
