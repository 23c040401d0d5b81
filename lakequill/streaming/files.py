"""A registered file table as a stream of its new files.

The engine itself is a batch engine; this only lets a projection or filter written for a
table run over files as they arrive, with Spark's own exactly-once file sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, kind: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append ``transform`` of every new file in ``folder`` to the Parquet folder ``target``; ends when all files are taken."""
    schema = spark.read.format(kind).load(folder).schema
    stream = transform(spark.readStream.schema(schema).format(kind).load(folder))
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
