"""Queries of what a single SQL text doesn't show: sources, DDL and DML, parameters, placement, user functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.operators import relational as R
from lakequill.plans.engine import Engine
from lakequill.plans.tables import engine, scratch, table
from lakequill.sources.registry import Registry

Query = Callable[[SparkSession, str], DataFrame]


def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.registry.register_dataframe("mem.users", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, None)], "id int, name string"))
    return e.sql("SELECT id, name FROM mem.users WHERE id <> 2")


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1200 AND l_quantity >= 25")


def three_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.registry.register_source("lake.raw.places", "parquet", f"{sf_dir}/nation.parquet")
    return e.sql("SELECT places.n_name, r_name FROM lake.raw.places JOIN main.default.region ON n_regionkey = r_regionkey")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'region'")


def changed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE work AS SELECT n_nationkey AS k, n_name AS name FROM nation")
    e.sql("INSERT INTO work (name, k) SELECT r_name, r_regionkey + 100 FROM region")
    e.sql("INSERT INTO work VALUES (500, NULL)")
    e.sql("DELETE FROM work WHERE name LIKE 'NATION%' AND k >= $1", [5])
    return e.sql("SELECT k, name FROM work")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE VIEW rich(id, money) AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
    e.sql("CREATE VIEW richest AS SELECT id, money FROM rich WHERE money > 9000")
    return e.sql("SELECT id, money FROM richest")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT o_orderkey, '$1' AS text FROM orders WHERE o_orderstatus = $2 AND o_totalprice > $1", [300000.0, "O"])


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1")


def by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation side is counted (it is a dimension) and so goes by broadcast."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    return R.joined_by_size(customers, nation, ["k"], nation.count()).select("c_custkey", "n_name")


def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parts = [orders.filter(F.col("o_orderkey") % 3 == k) for k in range(3)]
    return R.limited(R.merged(parts, ("o_totalprice", False), "o_orderkey"), 40, 3)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by key, then counted without another exchange."""
    return R.distributed(table(spark, sf_dir, "orders"), "HASH", 8, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"))


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)

    def reverse(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    e.register_function("backwards", F.pandas_udf(reverse, "string"))
    return e.sql("SELECT n_nationkey, backwards(n_name) AS v FROM nation")


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    e.register_function("spread", F.pandas_udf(spread, "double"))
    return e.sql("SELECT p_brand, spread(p_size) AS v FROM part GROUP BY p_brand")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)

    class Letters:
        def eval(self, s: str):
            for k, c in enumerate(s):
                yield k, c

    e.register_table_function("letters", F.udtf(Letters, returnType="pos int, letter string"))
    return e.sql("SELECT r_regionkey, t.pos, t.letter FROM region, LATERAL letters(r_name) t")


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV table of the whole customer table, read back with its schema."""
    e = engine(spark, sf_dir)
    folder = scratch(spark, "csv")
    e.sql("SELECT c_custkey, c_name, c_acctbal FROM customer").write.option("header", True).csv(folder)
    e.registry.register_csv("customers", folder, "c_custkey bigint, c_name string, c_acctbal double")
    return e.sql("SELECT c_custkey, c_name, c_acctbal FROM customers WHERE c_acctbal < 0")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's rows written in each format and codec, and one count for each as it is read back."""
    e = engine(spark, sf_dir)
    made = [("parquet", codec) for codec in ("none", "snappy", "gzip", "zstd", "lz4")] + [("orc", "zstd"), ("json", "none")]
    texts = []
    for kind, codec in made:
        folder = scratch(spark, f"{kind}-{codec}")
        e.export("SELECT n_nationkey, n_name FROM nation", folder, kind, compression=codec)
        e.registry.register_source(f"{kind}_{codec}", kind, folder)
        texts.append(f"SELECT '{kind}-{codec}' AS made, count(*) AS n, sum(length(n_name)) AS letters FROM {kind}_{codec}")
    return e.sql(" UNION ALL ".join(texts))


def metastore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of the session's metastore mounted as a schema, with a partitioned table."""
    e = engine(spark, sf_dir)
    name = "lq_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(spark, name)}'")
    e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation").write.partitionBy("n_regionkey").format("parquet").saveAsTable(f"{name}.places")
    e.registry.mount_hive_database(name, "warehouse")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM warehouse.places WHERE n_regionkey = 2")


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables named by a configuration file."""
    registry = Registry(spark)
    with tempfile.NamedTemporaryFile("w", suffix=".toml") as file:
        file.write(f'catalog = "lake"\nschema = "raw"\n[[tables]]\nname = "places"\nformat = "parquet"\npath = "{sf_dir}/nation.parquet"\n')
        file.flush()
        registry.load_config(file.name)
    return Engine(spark, registry).sql("SELECT n_name, n_regionkey FROM lake.raw.places")


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("SET search_path TO sales")
    return e.sql("SELECT current_database() AS db, current_schema() AS sch, version() IS NOT NULL AS known")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("RESET search_path")
    return e.sql("SHOW search_path")


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE made (k BIGINT, name VARCHAR(40), price DECIMAL(10,2))")
    e.sql("CREATE TABLE IF NOT EXISTS made (other INT)")
    e.sql("-- every customer\nINSERT INTO made SELECT c_custkey, c_name, c_acctbal FROM customer")
    e.sql("CREATE TABLE gone AS SELECT 1 AS x")
    e.sql("DROP TABLE gone")
    e.sql("DROP TABLE IF EXISTS gone")
    e.sql("CREATE VIEW seen AS SELECT k FROM made")
    e.sql("DROP VIEW seen")
    return e.sql("SELECT m.k, m.name, m.price, t.many FROM made m CROSS JOIN (SELECT count(*) AS many FROM information_schema.tables WHERE table_name IN ('made', 'gone', 'seen')) t")


def kept_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame made before a DELETE still reads what was there."""
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE work AS SELECT n_nationkey AS k FROM nation")
    before = e.sql("SELECT 'before' AS at, count(*) AS n FROM work")
    e.sql("DELETE FROM work WHERE k >= 10")
    return before.union(e.sql("SELECT 'after' AS at, count(*) AS n FROM work"))


def catalog_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table as clients of the wire protocol ask for them."""
    return engine(spark, sf_dir).sql("""
        SELECT n.nspname, c.relname, a.attname, a.attnum, t.typname, t.typlen FROM pg_catalog.pg_class c
        JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid
        WHERE c.relname = 'nation' AND NOT a.attisdropped""")


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("""
        SELECT 'database' AS what, datname AS name FROM pg_database UNION ALL SELECT 'schema', schema_name FROM information_schema.schemata
        UNION ALL SELECT 'table', table_name FROM information_schema.tables WHERE table_name IN ('orders', 'region')""")


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each placement scheme keeps every row; HASH puts a key in one place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = None
    for scheme in ("SINGLE", "HASH", "ROUND_ROBIN", "BROADCAST"):
        placed = R.distributed(orders, scheme, 4, ["o_custkey"])
        one = placed.agg(F.lit(scheme).alias("scheme"), F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))
        found = one if found is None else found.union(one)
    return found


#: The optimised plan of ``explained``.
_PLAN = """Project [n_name]
  Filter (isnotnull(n_regionkey) AND (n_regionkey = 1))
    Relation [n_nationkey,n_name,n_regionkey] parquet"""

#: name -> (query, DuckDB text; None where the rows are text of Spark's own)
QUERIES: dict[str, tuple[Query, str | None]] = {
    "s03_memory": (memory_source, "SELECT * FROM (VALUES (1, 'Alice'), (3, NULL)) v(id, name)"),
    "s08_pruned_scan": (pruned_scan, "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1200 AND l_quantity >= 25"),
    "s17_names": (three_part_names, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "s19_metadata": (metadata, "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(column_name, data_type)"),
    "s21_s26_changes": (changed_table, "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey + 100, r_name FROM region UNION ALL SELECT 500, NULL"),
    "s27_views": (views, "SELECT c_custkey AS id, c_acctbal AS money FROM customer WHERE c_acctbal > 9000"),
    "p21_parameters": (parameters, "SELECT o_orderkey, '$1' AS text FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000"),
    "p22_explain": (explained, f"SELECT '{_PLAN}' AS plan"),
    "s04_csv": (csv_source, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0"),
    "s07_s29_formats": (exported, "SELECT made, count(*) AS n, cast(sum(length(n_name)) AS bigint) AS letters FROM nation CROSS JOIN (VALUES ('parquet-none'), ('parquet-snappy'), ('parquet-gzip'), ('parquet-zstd'), ('parquet-lz4'), ('orc-zstd'), ('json-none')) v(made) GROUP BY made"),
    "s13_s14_metastore": (metastore, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "s18_config": (configured, "SELECT n_name, n_regionkey FROM nation"),
    "s19_pg_relations": (catalog_relations, "SELECT * FROM (VALUES ('default', 'nation', 'n_nationkey', 1, 'int4', 4::bigint), ('default', 'nation', 'n_name', 2, 'text', (-1)::bigint), ('default', 'nation', 'n_regionkey', 3, 'int4', 4::bigint)) v(nspname, relname, attname, attnum, typname, typlen)"),
    "s19_names": (catalog_names, "SELECT * FROM (VALUES ('database', 'main'), ('schema', 'default'), ('table', 'orders'), ('table', 'region')) v(what, name)"),
    "s20_session": (session_names, "SELECT 'main' AS db, 'sales' AS sch, true AS known"),
    "s20_show": (shown, "SELECT 'default' AS search_path"),
    "s21_s22_created": (created, "SELECT c_custkey AS k, c_name AS name, cast(c_acctbal AS decimal(10,2)) AS price, cast(1 AS bigint) AS many FROM customer"),
    "s26_snapshots": (kept_snapshot, "SELECT 'before' AS at, count(*) AS n FROM nation UNION ALL SELECT 'after', count(*) FROM nation WHERE n_nationkey < 10"),
    "d04_schemes": (schemes, "SELECT scheme, count(*) AS n, cast(sum(o_orderkey) AS bigint) AS total FROM orders CROSS JOIN (VALUES ('SINGLE'), ('HASH'), ('ROUND_ROBIN'), ('BROADCAST')) v(scheme) GROUP BY scheme"),
    "j17_by_size": (by_size, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "o08_merge": (merged_order, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 3"),
    "d03_hash_placement": (placed, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "u01_scalar_udf": (scalar_udf, "SELECT n_nationkey, reverse(n_name) AS v FROM nation"),
    "u02_aggregate_udf": (aggregate_udf, "SELECT p_brand, cast(max(p_size) - min(p_size) AS double) AS v FROM part GROUP BY p_brand"),
    "u03_table_function": (table_function, "SELECT r_regionkey, cast(p - 1 AS integer) AS pos, r_name[p] AS letter FROM (SELECT r_regionkey, r_name, unnest(range(1, length(r_name) + 1)) AS p FROM region)"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text}
