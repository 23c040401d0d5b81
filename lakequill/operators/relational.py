"""Relational operators with the engine's semantics, as DataFrame algebra.

They only fix what Spark leaves to choice or does otherwise: nulls last in every order,
ROWS frames for running windows, BIGINT ranks, residual conditions inside ON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.plans.coercion import supertype

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi-join on pairs of columns. ``residual`` is part of ON: rows that fail it count as
    unmatched, they are not filtered away. Null keys never match."""
    condition = residual
    for a, b in on:
        equal = left[a] == right[b]
        condition = equal if condition is None else condition & equal
    return left.join(right, condition, JOINS[how])


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition; Catalyst takes a hash or merge join if it holds an equality."""
    return left.join(right, condition, JOINS[how])


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Null-aware NOT IN: a null on the right leaves no row, a null on the left is dropped unless the right is empty.

    One aggregate tells whether the right side is empty or has a null; the rest is an
    equi-join, so neither side has to be broadcast.
    """
    value = right.select(F.col(other).alias("__value"))
    state = value.agg(F.count("*").alias("__rows"), F.count("__value").alias("__known"))  # one row
    kept = left.join(value, F.col(column) == F.col("__value"), "left_anti").join(F.broadcast(state))
    return kept.filter((F.col("__rows") == 0) | ((F.col("__rows") == F.col("__known")) & F.col(column).isNotNull())).drop("__rows", "__known")


def joined_by_size(left: DataFrame, right: DataFrame, on: list[str], right_rows: int, threshold: int = 10_000) -> DataFrame:
    """Distribution by size: the right side is broadcast if its counted rows are within ``threshold``, else both are dealt by key."""
    return left.join(F.broadcast(right) if right_rows <= threshold else right.hint("merge"), on)


def distributed(df: DataFrame, scheme: str, n: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """SINGLE, HASH (null keys together), ROUND_ROBIN or BROADCAST placement of rows."""
    match scheme.upper():
        case "SINGLE":
            return df.coalesce(1)
        case "HASH":
            return df.repartition(n, *keys)
        case "ROUND_ROBIN":
            return df.repartition(n)
        case "BROADCAST":
            return F.broadcast(df)
    raise ValueError(f"unknown scheme {scheme}")


def ordered(df: DataFrame, *keys: tuple[str, bool] | str) -> DataFrame:
    """Sort with nulls last in either direction; a key is a name or (name, ascending)."""
    pairs = [(k, True) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*(F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in pairs))


def limited(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    if (n is not None and n < 0) or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    if offset:
        df = df.offset(offset)
    return df if n is None else df.limit(n)


def merged(parts: Sequence[DataFrame], *keys: tuple[str, bool] | str) -> DataFrame:
    """One global order over several inputs."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return ordered(whole, *keys)


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cast, by position, to the supertype of each column; names come from the left."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"set operation on {len(left.columns)} and {len(right.columns)} columns")
    kinds = [supertype(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema)]
    names = left.columns
    cast = lambda df: df.toDF(*(f"c{k}" for k in range(len(names)))).select(*(F.col(f"c{k}").cast(t).alias(n) for k, (t, n) in enumerate(zip(kinds, names))))
    return cast(left), cast(right)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.union(b)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return union_all(left, right).distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.intersect(b)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.subtract(b)


def _window(partition: Sequence[str], order: Sequence[tuple[str, bool] | str]):
    spec = Window.partitionBy(*partition)
    pairs = [(k, True) if isinstance(k, str) else k for k in order]
    return spec.orderBy(*(F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in pairs)) if pairs else spec


def ranking(df: DataFrame, function: str, name: str, partition: Sequence[str], order: Sequence[tuple[str, bool] | str]) -> DataFrame:
    """ROW_NUMBER, RANK or DENSE_RANK as BIGINT."""
    f = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[function.lower()]
    return df.withColumn(name, f().over(_window(partition, order)).cast("bigint"))


def windowed(df: DataFrame, function: str, column: str, name: str, partition: Sequence[str], order: Sequence[tuple[str, bool] | str] = ()) -> DataFrame:
    """SUM, AVG, MIN, MAX (DOUBLE) or COUNT (BIGINT) over the whole partition, or, with an
    order, over the rows up to and including the current one."""
    spec = _window(partition, order)
    if order:
        spec = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = function.lower()
    value = F.count(column) if kind == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](column)
    return df.withColumn(name, value.over(spec).cast("bigint" if kind == "count" else "double"))


def aggregated(df: DataFrame, keys: Sequence[str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """Grouped, or without keys global (one row always), with a filter over the groups."""
    found = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return found if having is None else found.filter(having)
