"""DataFrame operators, functions and coercions on small fixtures."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.functions import scalar as S
from lakequill.operators import relational as R
from lakequill.plans.coercion import TypeMismatch, coercible, supertype


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")], "id int, name string")
    right = spark.createDataFrame([(2, 200), (3, 300), (5, 500), (None, 0)], "rid int, value bigint")
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 5), ("right", 4), ("full", 7), ("semi", 2), ("anti", 3)])
def test_joins(sides, how, n):
    assert R.join(*sides, [("id", "rid")], how).count() == n


def test_residual_is_part_of_on(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, tag string")
    right = spark.createDataFrame([(1, "keep"), (2, "skip"), (3, "keep")], "rid int, note string")
    found = R.join(left, right, [("id", "rid")], "left", right["note"] != "skip").select("id", "note")
    assert rows(found) == [(1, "keep"), (2, None), (3, "keep")]


def test_not_in_and_anti(spark, sides):
    left, right = sides
    assert R.not_in(left, "id", right, "rid").count() == 0
    assert rows(R.not_in(left, "id", right.filter("rid IS NOT NULL"), "rid").select("id")) == [(1,), (4,)]


def test_theta_cross_and_empty_sides(spark, sides):
    left, right = sides
    assert R.theta_join(left, right, F.col("id") < F.col("rid")).count() == 7
    assert R.theta_join(left.limit(0), right, F.col("id") < F.col("rid"), "right").count() == 4
    assert left.crossJoin(right).count() == 20


def test_distribution(spark, sides):
    left, right = sides
    right = right.withColumnRenamed("rid", "id")
    small = R.joined_by_size(left, right, ["id"], 4)
    large = R.joined_by_size(left, right, ["id"], 10_001)
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert rows(small) == rows(large)
    assert R.distributed(left, "HASH", 3, ["id"]).rdd.getNumPartitions() == 3
    assert R.distributed(left, "SINGLE").rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        R.distributed(left, "OTHER")


def test_order_and_limits(spark, sides):
    left, _ = sides
    assert [r.id for r in R.ordered(left, ("id", False)).collect()] == [4, 3, 2, 1, None]
    assert [r.id for r in R.ordered(left, "id").collect()] == [1, 2, 3, 4, None]
    assert [r.id for r in R.limited(R.ordered(left, "id"), 2, 1).collect()] == [2, 3]
    assert [r.id for r in R.merged([left, left], "id").collect()][:4] == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        R.limited(left, -1)


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (3,), (4,), (None,)], "y bigint")
    assert rows(R.intersect(a, b)) == [(2,), (3,), (None,)]
    assert rows(R.except_(a, b)) == [(1,)]
    assert R.union_all(a, b).count() == 9 and R.union(a, b).count() == 5
    assert R.union_all(a, b).schema["x"].dataType == T.LongType()
    with pytest.raises(ValueError):
        R.union_all(a, b.withColumn("z", F.lit(1)))


def test_windows(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 20, 3)], "g string, v int, k int")
    assert [r.r for r in R.ranking(df, "rank", "r", ["g"], ["v"]).orderBy("k").collect()] == [1, 1, 3]
    assert [r.r for r in R.ranking(df, "dense_rank", "r", ["g"], ["v"]).orderBy("k").collect()] == [1, 1, 2]
    assert R.ranking(df, "row_number", "r", ["g"], ["v", "k"]).schema["r"].dataType == T.LongType()
    assert [r.s for r in R.windowed(df, "sum", "v", "s", ["g"], ["k"]).orderBy("k").collect()] == [10.0, 20.0, 40.0]
    assert {r.s for r in R.windowed(df, "count", "v", "s", ["g"]).collect()} == {3}


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 10, 1.5), (None, 20, 2.5), (3, 30, 3.0)], "i int, b bigint, d double")
    found = R.aggregated(df, [], n=F.count("*"), c=F.count("i"), s=F.sum("b"), d=F.sum("d"))
    assert rows(found) == [(3, 2, 60, 7.0)]
    assert rows(R.aggregated(df.limit(0), [], s=F.sum("b"), n=F.count("*"))) == [(None, 0)]
    assert rows(R.aggregated(df, ["i"], F.col("n") > 0, n=F.count("b"))) == [(1, 1), (3, 1), (None, 1)]


def test_scalar_subquery_with_two_rows_is_an_error(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT (SELECT id FROM range(2))").collect()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("make", "wanted"),
    [
        (lambda: S.substring(F.lit("hello world"), F.lit(7), F.lit(5)), "world"),
        (lambda: S.substring(F.lit("hello"), F.lit(-3), F.lit(2)), "he"),
        (lambda: S.substring(F.lit("hello"), F.lit(9)), ""),
        (lambda: S.substring(F.lit("hello"), F.lit(2), F.lit(-1)), ""),
        (lambda: S.position(F.lit("world"), F.lit("hello world")), 7),
        (lambda: S.position(F.lit("x"), F.lit("hello")), 0),
        (lambda: S.position(F.lit(""), F.lit("hello")), 1),
        (lambda: S.concat(F.lit("a"), F.lit(None).cast("string")), None),
        (lambda: S.length(F.lit("日本語")), 3),
        (lambda: S.trim(F.lit("\u00a0\t a b \n")), "a b"),
        (lambda: S.ltrim(F.lit("\t a ")), "a "),
        (lambda: S.rtrim(F.lit(" a\t ")), " a"),
        (lambda: S.replace(F.lit("aXbX"), F.lit("X"), F.lit("-")), "a-b-"),
        (lambda: S.replace(F.lit("ab"), F.lit(""), F.lit("-")), "-a-b-"),
        (lambda: S.round_(F.lit(1.5)), 2.0),
        (lambda: S.round_(F.lit(-2.5)), -3.0),
        (lambda: S.round_(F.lit(3.14159), 2), 3.14),
        (lambda: S.ceil(F.lit(-1.5)), -1.0),
        (lambda: S.floor(F.lit(-1.5)), -2.0),
        (lambda: S.mod(F.lit(10.5), F.lit(3)), 1.5),
        (lambda: S.mod(F.lit(-7), F.lit(3)), -1.0),
        (lambda: S.mod(F.lit(7), F.lit(0)), None),
        (lambda: S.power(F.lit(9), F.lit(0.5)), 3.0),
        (lambda: S.abs_(F.lit(-5)), 5),
        (lambda: S.extract("year", F.lit("2024-01-15").cast("date")), 2024),
        (lambda: S.date_trunc("month", F.lit("2024-03-15").cast("date")), datetime.date(2024, 3, 1)),
        (lambda: S.date_trunc("day", F.lit("2024-03-15").cast("date")), datetime.date(2024, 3, 15)),
        (lambda: S.upper(F.lit("straße")), "STRASSE"),
        (lambda: S.lower(F.lit(None).cast("string")), None),
    ],
)
def test_functions(spark, make, wanted):
    assert one(spark, make()) == wanted


def test_function_registry():
    known = S.default_registry()
    assert len(known.names()) == 19 and known.get("UPPER") is S.upper
    known.register("Twice", lambda c: c * 2)
    assert known.get("twice")
    with pytest.raises(LookupError):
        known.get("nope")
    with pytest.raises(ValueError):
        S.extract("week", "d")


def test_coercions():
    dec = T.DecimalType
    assert supertype(T.IntegerType(), T.LongType()) == T.LongType()
    assert supertype(T.LongType(), T.FloatType()) == T.DoubleType()
    assert supertype(dec(10, 2), dec(12, 4)) == dec(12, 4)
    assert supertype(T.LongType(), dec(10, 2)) == dec(21, 2)
    assert supertype(dec(10, 2), T.DoubleType()) == T.DoubleType()
    assert supertype(T.NullType(), T.DateType()) == T.DateType()
    for a, b in ((T.DateType(), T.TimestampType()), (T.BooleanType(), T.IntegerType()), (T.StringType(), T.LongType())):
        with pytest.raises(TypeMismatch):
            supertype(a, b)
    assert coercible(T.StringType(), T.DateType(), literal=True) and not coercible(T.StringType(), T.DateType())
    assert coercible(T.IntegerType(), T.DoubleType()) and not coercible(T.DoubleType(), T.IntegerType())
