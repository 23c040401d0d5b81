"""Every registered query of the engine with its oracle text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lakequill.plans import engine_queries, functions_queries, operators_sql, tpch
from lakequill.plans.tables import run_sql

Query = Callable[[SparkSession, str], DataFrame]

TEXTS = {**operators_sql.SQL, **functions_queries.SQL, **tpch.SQL}


def _run(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, text)


def queries() -> dict[str, Query]:
    return {name: partial(_run, text) for name, (text, _) in TEXTS.items()} | engine_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in TEXTS.items()} | engine_queries.oracle_sql()
