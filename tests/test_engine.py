"""Registry, names, parameters, DDL and DML, metadata, EXPLAIN."""

from __future__ import annotations

import datetime
import io

import pytest

from lakequill.__main__ import main
from lakequill.plans import lexer
from lakequill.plans.names import rename_tables
from lakequill.plans.coercion import TypeMismatch
from lakequill.plans.engine import Engine
from lakequill.sources.registry import Registry, TableNotFound, storage_uri


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, warehouse=str(tmp_path))
    e.registry.register_dataframe("users", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Carol")], "id int, name string"))
    e.registry.register_dataframe("sales.orders", spark.createDataFrame([(10, 1, 100.0), (20, 2, 200.0), (30, 1, 150.0), (40, 3, 300.0)], "id int, user_id int, amount double"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_two_tables(engine):
    assert len(rows(engine.sql("SELECT * FROM users u JOIN sales.orders o ON u.id = o.user_id"))) == 4
    assert rows(engine.sql("SELECT id FROM users ORDER BY id DESC LIMIT 2")) == [(3,), (2,)]


def test_names_of_one_to_three_parts(engine):
    assert rows(engine.sql("SELECT main.sales.orders.id FROM main.sales.orders WHERE orders.amount > 250")) == [(40,)]
    assert rows(engine.sql("SELECT count(*) FROM users, sales.orders")) == [(12,)]
    with pytest.raises(ValueError):
        engine.registry.full_name("a.b.c.d")
    with pytest.raises(TableNotFound):
        engine.registry.resolve("Users")  # table names are case-sensitive


def test_column_names_ignore_case(engine):
    assert rows(engine.sql("SELECT NAME FROM users WHERE Id = 2")) == [("Bob",)]


def test_parameters(engine):
    assert rows(engine.sql("SELECT name, '$1', \"$2\" FROM users -- $3\nWHERE id = $1 OR name = $2 ORDER BY id", [1, "Bob"])) == [("Alice", "$1", "$2"), ("Bob", "$1", "$2")]
    assert rows(engine.sql("SELECT name FROM users WHERE name = $1", ["1' OR '1'='1"])) == []
    with pytest.raises(ValueError):
        engine.sql("SELECT $2", [1])


def test_lexer_keeps_text():
    sql = "SELECT 'it''s', \"a.b\", `x``y`, /* t.c */ 1.5e3 FROM a.b -- end"
    assert "".join(t.text for t in lexer.tokens(sql)) == sql
    assert rename_tables(sql, lambda p: "v" if p == ("a", "b") else None) == sql.replace("FROM a.b", "FROM `v` AS `b`")


def test_create_insert_delete(engine):
    engine.sql("CREATE TABLE t (id INT, name VARCHAR(10), price DECIMAL, at TIMESTAMP)")
    assert engine.sql("SELECT * FROM t").schema["price"].dataType.simpleString() == "decimal(38,0)"
    engine.sql("INSERT INTO t VALUES (1, 'a', 3, TIMESTAMP '2020-01-01 00:00:00'), (2, NULL, 4, NULL)")
    engine.sql("INSERT INTO t (name, id) SELECT name, id FROM users WHERE id = $1", [3])
    engine.sql("DELETE FROM t WHERE name = 'a'")
    assert sorted(rows(engine.sql("SELECT id, name FROM t"))) == [(2, None), (3, "Carol")]  # unknown is kept
    engine.sql("INSERT INTO t SELECT * FROM t")
    assert rows(engine.sql("SELECT count(*) FROM t")) == [(4,)]
    engine.sql("DELETE FROM t")
    assert rows(engine.sql("SELECT count(*) FROM t")) == [(0,)]
    engine.sql("CREATE TABLE IF NOT EXISTS t (id INT)")
    with pytest.raises(ValueError):
        engine.sql("CREATE TABLE t (id INT)")
    engine.sql("DROP TABLE t")
    engine.sql("DROP TABLE IF EXISTS t")
    with pytest.raises(TableNotFound):
        engine.sql("DROP TABLE t")


def test_delete_from_a_memory_table(engine):
    engine.sql("DELETE FROM users WHERE id >= 2")
    assert rows(engine.sql("SELECT id FROM users")) == [(1,)]


def test_create_table_as_select_is_a_snapshot(engine):
    engine.sql("CREATE TABLE copy AS SELECT id, amount FROM sales.orders WHERE amount > 100")
    engine.sql("DELETE FROM sales.orders")
    assert rows(engine.sql("SELECT count(*) FROM copy")) == [(3,)]


def test_views_nest_and_follow_data(engine):
    engine.sql("CREATE TABLE t (id INT)")
    engine.sql("CREATE VIEW v(a) AS SELECT id FROM t WHERE id > 1")
    engine.sql("CREATE VIEW w AS SELECT a + 1 AS b FROM v")
    engine.sql("INSERT INTO t VALUES (1), (2), (3)")
    assert sorted(rows(engine.sql("SELECT b FROM w"))) == [(3,), (4,)]
    engine.sql("CREATE OR REPLACE VIEW v AS SELECT 9 AS a")
    assert rows(engine.sql("SELECT b FROM w")) == [(10,)]
    with pytest.raises(ValueError):
        engine.sql("CREATE VIEW v AS SELECT 1 AS a")
    with pytest.raises(ValueError):
        engine.sql("DROP TABLE v")
    engine.sql("DROP VIEW w")


def test_metadata(engine):
    assert rows(engine.sql("SELECT table_name FROM information_schema.tables WHERE table_schema = 'sales'")) == [("orders",)]
    assert rows(engine.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'users' ORDER BY ordinal_position")) == [("id", "int"), ("name", "string")]
    assert rows(engine.sql("SELECT c.relname, a.attname, t.typname FROM pg_catalog.pg_class c JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid WHERE a.attname = 'amount'")) == [("orders", "amount", "float8")]
    assert ("main", "sales") in rows(engine.sql("SELECT * FROM information_schema.schemata"))


def test_session_and_explain(engine):
    assert rows(engine.sql("SHOW search_path")) == [("default",)]
    engine.sql("SET search_path TO sales")
    assert rows(engine.sql("SELECT count(*) FROM orders")) == [(4,)]
    plan = rows(engine.sql("EXPLAIN SELECT id FROM orders WHERE true AND amount > 1"))
    assert len(plan) == 1 and "Filter" in plan[0][0] or "LocalRelation" in plan[0][0] or "LogicalRDD" in plan[0][0]
    assert rows(engine.sql("SELECT version() IS NOT NULL"))[0][0]


def one(engine, text, params=None):
    found = rows(engine.sql(text, params))
    assert len(found) == 1
    return found[0]


def test_functions_in_sql(engine):
    assert one(engine, "SELECT substring('abcdef', -2, 3), substring('abcdef' FROM 2 FOR 2), substring('abcdef', 4, -1), substring(NULL, 1)") == ("abc", "bc", "", None)
    assert one(engine, "SELECT trim(' \t x\u00a0 '), ltrim('\tx '), rtrim(' x\n'), trim(BOTH 'x' FROM 'xax')") == ("x", "x ", " x", "a")
    assert one(engine, "SELECT mod(5, 0), mod(-7, 3), replace('ab', '', '-'), replace('', '', '-'), replace('aXa', 'a', ''), position('' IN 'abc'), position('c', 'abc'), power(2, 3)") == (None, -1.0, "-a-b-", "-", "X", 1, 3, 8.0)
    kinds = dict(engine.sql("SELECT length('a') AS a, position('a' IN 'a') AS b, extract(YEAR FROM DATE '2020-01-01') AS c, round(2.5) AS d, ceil(2) AS e, date_trunc('month', DATE '2020-02-03') AS f, row_number() OVER (ORDER BY 1) AS g").dtypes)
    assert kinds == {"a": "bigint", "b": "bigint", "c": "bigint", "d": "double", "e": "double", "f": "date", "g": "bigint"}
    assert one(engine, "SELECT length(trim(concat(' ', upper('ab'), ' ')))") == (2,)
    for bad in ("SELECT date_trunc('CENTURY', DATE '2020-01-01')", "SELECT extract(WEEK FROM DATE '2020-01-01')"):
        with pytest.raises(ValueError):
            engine.sql(bad)


def test_whole_division_by_types(engine):
    assert one(engine, "SELECT 7/2, -7/2, 7.0/2, cast(7 AS double)/2, 100/7/2, (1+2)/2*3, 7 % 4 / 2") == (3, -3, 3.5, 3.5, 7, 3, 1)
    assert one(engine, "SELECT CASE WHEN 3/2 = 1 THEN 9/2 ELSE 0 END / 3, '7/2', $1/2, $2/2", [7.0, 7]) == (1, "7/2", 3.5, 3)
    assert one(engine, "SELECT sum(id/2), (SELECT max(user_id)/2 FROM sales.orders) FROM users WHERE id/2 IN (SELECT user_id/2 FROM sales.orders)") == (2, 1)


def test_null_order_and_frames(engine, spark):
    engine.registry.register_dataframe("t", spark.createDataFrame([(1, 1), (2, None), (3, 2)], "k int, v int"))
    assert [r[0] for r in rows(engine.sql("SELECT k FROM t ORDER BY v"))] == [1, 3, 2]
    assert [r[0] for r in rows(engine.sql("SELECT k FROM t ORDER BY v DESC LIMIT 3"))] == [3, 1, 2]
    assert [r[0] for r in rows(engine.sql("SELECT k FROM t ORDER BY v NULLS FIRST, k"))] == [2, 1, 3]
    assert rows(engine.sql("SELECT s FROM (SELECT k, sum(x) OVER (ORDER BY k) AS s FROM (VALUES (1, 10), (2, 20), (2, 5)) v(k, x)) ORDER BY s")) in ([(10.0,), (30.0,), (35.0,)], [(10.0,), (15.0,), (35.0,)])


def test_names_in_scopes(engine, spark):
    assert one(engine, "WITH users AS (SELECT 1 AS x) SELECT * FROM users") == (1,)
    assert one(engine, "WITH u AS (SELECT count(*) AS n FROM users), users AS (SELECT 5 AS z) SELECT n, z FROM u, users") == (3, 5)
    assert one(engine, "SELECT (WITH users AS (SELECT 7 AS x) SELECT x FROM users) AS a, count(*) FROM users") == (7, 3)
    assert one(engine, "SELECT extract(YEAR FROM users), substring(orders FROM 1 FOR 1) FROM (SELECT DATE '2020-05-05' AS users, 'abc' AS orders) x") == (2020, "a")
    assert one(engine, "SELECT count(*) FROM users u JOIN (users v JOIN sales.orders o ON o.user_id = v.id) ON u.id = v.id, users w") == (12,)


def test_not_in_is_no_growing_broadcast(engine, spark):
    engine.registry.register_dataframe("t", spark.createDataFrame([(1,), (None,), (9,)], "k int"))
    engine.registry.register_dataframe("none", spark.createDataFrame([], "k int"))
    assert rows(engine.sql("SELECT k FROM t WHERE k NOT IN (SELECT id FROM users) AND true")) == [(9,)]
    assert rows(engine.sql("SELECT id FROM users WHERE id NOT IN (SELECT k FROM t)")) == []
    assert len(rows(engine.sql("SELECT k FROM t WHERE k NOT IN (SELECT k FROM none)"))) == 3
    assert rows(engine.sql("SELECT k FROM t WHERE k = 1 OR k NOT IN (SELECT id FROM users) ORDER BY k")) == [(1,), (9,)]
    assert rows(engine.sql("SELECT u.id FROM users u WHERE u.id NOT IN (SELECT o.user_id FROM sales.orders o WHERE o.user_id = u.id AND o.amount > 150)")) == [(1,)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = engine.sql("SELECT id FROM users WHERE id NOT IN (SELECT k FROM t)")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan


def test_comments_and_readers_of_old_snapshots(engine):
    engine.sql("/* a */ -- b\nCREATE TABLE t AS SELECT id FROM users")
    seen = engine.sql("SELECT id FROM t")
    engine.sql("-- c\nDELETE FROM t WHERE id > 1 -- d")
    assert seen.count() == 3 and engine.sql("SELECT id FROM t").count() == 1
    engine.sql("DROP TABLE t;")
    engine.sql("CREATE TABLE t (id INT)")
    engine.vacuum()
    assert engine.sql("SELECT id FROM t").count() == 0


def test_strict_coercion(engine, spark):
    strict = Engine(spark, engine.registry, strict=True)
    spark.createDataFrame([(1, "1", datetime.date(2020, 1, 1))], "i int, s string, d date").createOrReplaceTempView("lq_strict")
    assert one(strict, "SELECT i + 1.5, i = cast(s AS int), d < '2021-01-01', i / 2, i IN (1, 2.0) FROM lq_strict")[1:4] == (True, True, 0)
    for bad in ("SELECT i = s FROM lq_strict", "SELECT d = s FROM lq_strict", "SELECT i + s FROM lq_strict", "SELECT 1 FROM lq_strict WHERE EXISTS (SELECT 1 FROM users WHERE name = 5)"):
        with pytest.raises(TypeMismatch):
            strict.sql(bad)


def test_export(engine, tmp_path):
    engine.export("SELECT id, name FROM users WHERE id > $1", f"{tmp_path}/out", "csv", [1])
    engine.registry.register_csv("back", f"{tmp_path}/out", "id int, name string")
    assert sorted(rows(engine.sql("SELECT id, name FROM back"))) == [(2, "Bob"), (3, "Carol")]
    with pytest.raises(LookupError):
        engine.export("SELECT 1 AS x", f"{tmp_path}/y", "xls")


def test_file_sources(spark, tmp_path):
    r = Registry(spark)
    (tmp_path / "a.csv").write_text("id,name\n1,alice\n2,bob\n3,carol\n")
    r.register_csv("a", str(tmp_path / "a.csv"), "id INT, name STRING")
    assert rows(r.resolve("a").load()) == [(1, "alice"), (2, "bob"), (3, "carol")]
    with pytest.raises(ValueError):
        r.register_source("b", "csv", str(tmp_path / "a.csv"))
    for codec in ("none", "snappy", "gzip", "zstd", "lz4"):
        spark.range(3).write.option("compression", codec).parquet(str(tmp_path / codec))
        r.register_source(codec, "parquet", str(tmp_path / codec))
        assert r.resolve(codec).load().count() == 3
    nested = spark.createDataFrame([(1, ["a", "b"], "alice"), (2, ["c"], "bob")], "id int, tags array<string>, name string")
    nested.write.parquet(str(tmp_path / "nested"))
    r.register_source("nested", "parquet", str(tmp_path / "nested"))
    picked = r.resolve("nested").load().select("name", "id")
    assert picked.columns == ["name", "id"] and rows(picked)[0] in (("alice", 1), ("bob", 2))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "tags" not in plan.split("ReadSchema")[1]


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).filter("id > 90").select("v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "s:string" not in plan.split("ReadSchema")[1]


def test_config(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,at\n1,2020-01-01\n")
    (tmp_path / "c.toml").write_text(f'catalog = "lake"\nschema = "raw"\n[storage]\nazure_account = "acc"\n"fs.s3a.endpoint" = "http://host:9000"\n[[tables]]\nname = "e"\nformat = "csv"\npath = "{tmp_path}/e.csv"\ncolumns = [{{name = "id", type = "int64", nullable = false}}, {{name = "at", type = "date32"}}]\n')
    r = Registry(spark)
    r.load_config(tmp_path / "c.toml", {"LAKEQUILL_SCHEMA": "best"})
    assert r.azure_account == "acc" and spark._jsc.hadoopConfiguration().get("fs.s3a.endpoint") == "http://host:9000"
    assert rows(r.resolve("lake.best.e").load()) == [(1, datetime.date(2020, 1, 1))]


def test_command_line(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").coalesce(1).write.parquet(f"{tmp_path}/p")
    (tmp_path / "c.toml").write_text(f'catalog = "lake"\nschema = "raw"\n[[tables]]\nname = "t"\nformat = "parquet"\npath = "{tmp_path}/p"\n')
    out = io.StringIO()
    main(["--config", f"{tmp_path}/c.toml", "SELECT id, name FROM lake.raw.t ORDER BY id"], spark, out)
    assert out.getvalue() == "id,name\n1,a\n2,\n"
    monkeypatch.setenv("LAKEQUILL_SCHEMA", "env")
    for argv, wanted in ((["--schema", "cli"], "cli"), ([], "env")):
        out = io.StringIO()
        main([*argv, "--table", f"u=parquet:{tmp_path}/p", "SELECT current_schema() AS s, count(*) AS n FROM u"], spark, out)
        assert out.getvalue() == f"s,n\n{wanted},2\n"
    main(["--table", f"u=parquet:{tmp_path}/p", "--output", f"{tmp_path}/o", "--format", "csv", "SELECT id FROM u"], spark)
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").count() == 2


def test_storage_uris():
    assert storage_uri("s3://b/k") == "s3a://b/k" and storage_uri("az://c/x", "acc") == "abfss://c@acc.dfs.core.windows.net/x" and storage_uri("az://c@a.host/x") == "abfss://c@a.host/x" and storage_uri("/tmp/x") == "/tmp/x"
    for bad in ("ftp://x/y", "az://c/x"):
        with pytest.raises(ValueError):
            storage_uri(bad)
