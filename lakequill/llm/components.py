"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hangs its larger (large) or its smaller (small) neighbours on the least of them."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = around.join(least, "u")
    if large:
        found = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return found.filter(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each from a larger to a smaller node, are stars: no node hangs twice, or hangs and is hung on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below > 0 and above > 0)")
    return odd.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the least node that edges reach from each node; nodes without edges are left out.

    Ids are long. Each step is written to the shared folder, so lineage stays short; the
    steps end when the edges are stars.
    """
    ends = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = written(ends.filter("u <> v").distinct(), "edges")
    while not _settled(now):
        now = written(_star(_star(now, True), False), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
