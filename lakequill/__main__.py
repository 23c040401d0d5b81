"""Run one statement from the command line::

    python -m lakequill --config lake.toml --table "places=parquet:/data/places" "SELECT count(*) FROM places"

Settings of the command line go before those of the environment (LAKEQUILL_CATALOG,
LAKEQUILL_SCHEMA), and these before the file's. Rows are printed as CSV with a header, or
written with ``--output``.
"""

from __future__ import annotations

import argparse
import csv
import os
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import SparkSession

from lakequill.plans.engine import Engine
from lakequill.session import build_session
from lakequill.sources.registry import Registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakequill", description="Run one SQL statement.")
    p.add_argument("--config", help="TOML file of tables and defaults")
    p.add_argument("--catalog")
    p.add_argument("--schema")
    p.add_argument("--table", action="append", default=[], metavar="NAME=FORMAT:PATH", help="a table; may be repeated")
    p.add_argument("--strict", action="store_true", help="refuse operands that no rule of coercion brings together")
    p.add_argument("--output", help="write the rows to this folder instead of printing them")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "orc", "json"), help="of --output")
    p.add_argument("--master", help="Spark master, where the session is not given by spark-submit")
    p.add_argument("sql")
    return p


def engine_of(args: argparse.Namespace, spark: SparkSession, environment: dict[str, str]) -> Engine:
    registry = Registry(spark)
    chosen = dict(environment) | {f"LAKEQUILL_{k.upper()}": v for k in ("catalog", "schema") if (v := getattr(args, k))}
    if args.config:
        registry.load_config(args.config, chosen)
    else:
        registry.catalog, registry.schema = chosen.get("LAKEQUILL_CATALOG", registry.catalog), chosen.get("LAKEQUILL_SCHEMA", registry.schema)
    for text in args.table:
        name, _, source = text.partition("=")
        kind, _, path = source.partition(":")
        registry.register_source(name, kind, path)
    return Engine(spark, registry, strict=args.strict)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out: TextIO = sys.stdout) -> None:
    args = parser().parse_args(argv)
    engine = engine_of(args, spark or build_session(args.master), dict(os.environ))
    if args.output:
        engine.export(args.sql, args.output, args.format)
        return
    found = engine.sql(args.sql)
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(found.columns)
    for row in found.toLocalIterator():  # one partition at a time
        writer.writerow(["" if v is None else v for v in row])


if __name__ == "__main__":
    main()
