"""Exact top-k search by multi-index hashing (operator 7).

Vectors become binary codes, one bit for the sign of each dimension. Codes are cut into
segments of 16 bits, and an index has each distinct code under each of its segments. A
search at radius r looks up every value within r of a query's segments. All codes within
``segments * (r + 1) - 1`` of the query have been met then, so a query is done once its
kth best verified Hamming distance is no larger; the others go on to radius r + 1.
Where the next radius would cost a query more than a look at every code (a small table, or
one that is far from the query), the rest is verified exactly: the queries that are left go
against all codes in blocks.

Equal codes are one entry with its k least ids, so a vector that a third of all rows
repeat is one code. A code is met at one radius and in one segment only: the first
segment whose distance is the least of its segments.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.shared import written

SEGMENT = 16
#: A probe that is dealt out and joined costs as much as so many codes that are looked at in place.
PROBE_COST = 32
#: Queries of a block that is compared with all codes, and index rows of a value beyond which it is dealt out in parts.
QUERY_BLOCK, HOT_ROWS = 2048, 100_000


def code_of(vector: Column, words: int) -> list[Column]:
    """The code as ``words`` 64-bit numbers: bit i is set if dimension i is positive."""
    bits = F.transform(vector, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return [F.aggregate(F.slice(bits, F.lit(64 * w + 1), F.lit(64)), F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("c")), lambda acc, b: F.struct((acc["i"] + 1).alias("i"), acc["c"].bitwiseOR(F.call_function("shiftleft", b, acc["i"])).alias("c")), lambda acc: acc["c"]) for w in range(words)]


def _segments(words: int, name: str) -> list[Column]:
    return [F.shiftrightunsigned(F.col(f"{name}{j // 4}"), SEGMENT * (j % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int") for j in range(4 * words)]


def _against_all(codes: DataFrame, active: DataFrame, q_names: list[str], columns: list, distance: Column, nearest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The nearest codes of each active query, from blocks of QUERY_BLOCK queries against all codes."""
    blocks = -(-active.count() // QUERY_BLOCK)
    numbered = written(active.withColumn("block", F.pmod(F.xxhash64(*q_names), F.lit(max(1, blocks)))), "numbered")
    found = None
    for block in range(max(1, blocks)):
        some = F.broadcast(numbered.filter(F.col("block") == block))  # about QUERY_BLOCK rows
        one = nearest(codes.join(some, distance <= F.col("bound")).select(*columns))
        found = one if found is None else found.union(one)
    return written(found, "scanned")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of ``vectors`` for each row of ``queries``.

    Ranks go by Hamming distance, then id. A query finds itself if it is among the vectors.
    Null vectors are left out on both sides; missing dimensions count as not positive, nulls
    within a vector too. With fewer than k rows all are returned. Repeated rows are ranked
    each; a repeated query id with another vector is ranked for both. Other columns are
    left out.
    """
    words = max(1, -(-dimensions // 64))
    many = 4 * words
    names = [f"c{w}" for w in range(words)]

    def coded(df: DataFrame, name: str) -> DataFrame:
        some = df.filter(F.col(vector_col).isNotNull())
        return some.select(F.col(id_col).cast("long").alias(name), *(c.alias(n) for c, n in zip(code_of(F.col(vector_col), words), names)))

    rows = coded(vectors, "id")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).filter(F.col("r") <= k)
    members = written(ranked.select(*names, "id", "r"), "members")
    codes = written(members.groupBy(*names).agg(F.count("*").alias("mult"), F.min("id").alias("least")), "codes")
    n_codes = codes.count()
    entries = F.explode(F.array(*(F.struct(F.lit(j).alias("seg"), v.alias("value")) for j, v in enumerate(_segments(words, "c")))))
    entered = codes.select(*names, "mult", "least", entries.alias("e")).select(*names, "mult", "least", "e.seg", "e.value")
    # A value that very many codes have is dealt out in parts, and its probes to each of them.
    parts = written(entered.groupBy("seg", "value").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts")).filter("parts > 1"), "parts")
    split = not parts.isEmpty()
    if split:
        entered = entered.join(parts, ["seg", "value"], "left").withColumn("part", F.pmod(F.xxhash64(*names), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    keys = ["seg", "value", "part"] if split else ["seg", "value"]
    index = written(entered, "index")

    asked = written(coded(queries, "query_id").distinct(), "queries").withColumnsRenamed({n: f"q{w}" for w, n in enumerate(names)})
    q_names = [f"q{w}" for w in range(words)]
    active = written(asked.select(*q_names).distinct().withColumn("bound", F.lit(64 * words)), "active")
    best = None
    apart = lambda j: F.bit_count(_segments(words, "q")[j].bitwiseXOR(_segments(words, "c")[j]))
    distance = sum((F.bit_count(F.col(f"q{w}").bitwiseXOR(F.col(f"c{w}"))) for w in range(words)), F.lit(0)).cast("int")
    met_columns = [*q_names, *names, "mult", "least", distance.alias("distance")]
    order = Window.partitionBy(*q_names).orderBy("distance", "least", *names)
    nearest = lambda pool: pool.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
    for radius in range(SEGMENT + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)]
        if many * len(masks) * PROBE_COST > n_codes:
            scanned = _against_all(codes, active, q_names, met_columns, distance, nearest)
            best = scanned if best is None else best.join(active.select(*q_names), q_names, "left_anti").union(scanned)
            break
        # Few queries are one file: they are dealt out before each becomes many probes.
        dealt = active.repartition(*q_names)
        probes = dealt.select(*q_names, "bound", F.explode(F.array(*(F.struct(F.lit(j).alias("seg"), v.alias("own")) for j, v in enumerate(_segments(words, "q"))))).alias("e"))
        flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")  # a constant
        probes = probes.select(*q_names, "bound", "e.seg", "e.own", F.explode(flips).alias("mask"))
        probes = probes.select(*q_names, "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        if split:
            probes = probes.join(parts, ["seg", "value"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        first = F.lit(True)
        for j in range(many):  # met before: at a smaller radius, or in an earlier segment at this one
            first = first & F.when(F.col("seg") > j, apart(j) > radius).otherwise(apart(j) >= radius)
        # Probes are many times the rows that Spark expects of them: never a side to broadcast.
        met = probes.hint("merge").join(index, keys).filter(first & (distance <= F.col("bound"))).select(*met_columns)
        best = written(nearest(met if best is None else met.union(best)), "best")
        sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kth = best.withColumn("until", F.sum("mult").over(sums)).filter(F.col("until") >= k).groupBy(*q_names).agg(F.min("distance").alias("kth"))
        # Who goes on needs codes no farther than its kth best so far.
        going = active.drop("bound").join(kth, q_names, "left").filter(F.col("kth").isNull() | (F.col("kth") > many * (radius + 1) - 1))
        active = written(going.select(*q_names, F.coalesce("kth", F.lit(64 * words)).cast("int").alias("bound")), "active")
        if active.isEmpty():
            break
    hits = asked.join(best.drop("mult", "least"), q_names).join(members.select(*names, "id"), names)
    final = Window.partitionBy("query_id", *q_names).orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
