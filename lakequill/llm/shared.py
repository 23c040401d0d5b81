"""Tables that cut lineage: written to the folder all executors share, and read back.

Operators are lazy, so their tables must outlive the call. They belong to the scope that
is open when they are written: ``scope()`` hands out the list, and ``drop_paths()`` removes
what is in it once the results are stored. Without an open scope they stay until the
folder is cleaned, so no result can lose its tables to another operator.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCOPE: ContextVar[list[str] | None] = ContextVar("lakequill_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a local folder, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakequill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def scope(paths: list[str]) -> Iterator[list[str]]:
    """Tables written inside are listed in ``paths``."""
    before = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(before)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, listed in the open scope."""
    path = f"{shared_dir(spark)}/lakequill/{uuid.uuid4().hex}/{name}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors cost no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.lakequill_path = path
    return found


def drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for t in tables:
        drop_paths(t.sparkSession, [t.lakequill_path])
        if (paths := _SCOPE.get()) is not None and t.lakequill_path in paths:
            paths.remove(t.lakequill_path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove the listed tables, with the folders made for them, and empty the list."""
    while paths:
        drop(spark, paths.pop().rsplit("/", 1)[0])


#: Keys that looked_up() takes out of its shuffle.
HOT_KEYS = 512


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row for each key and the key's number of rows in ``weight``.

    The HOT_KEYS keys with most rows go by a broadcast of that many rows, so that no task
    gets a hot key's rows; all others are dealt out by key. No row is lost or repeated.
    """
    lookup = written(lookup, "lookup")
    hot = F.broadcast(lookup.orderBy(F.desc(weight), *keys).limit(HOT_KEYS).drop(weight))
    lead = rows.join(hot, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup.drop(weight), keys, how)
    return lead.unionByName(rest)


def met_often(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of a stored table ``rows`` with ``lookup``, as looked_up() does it; the keys are counted here."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys)
    hot = F.broadcast(written(hot, "hot"))
    lead = rows.join(F.broadcast(lookup.join(hot, keys, "left_semi")), keys)
    return lead.unionByName(rows.join(hot, keys, "left_anti").join(lookup, keys))
