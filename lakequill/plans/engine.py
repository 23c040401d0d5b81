"""The SQL front end: names of a registry, numbered parameters, DDL and DML, metadata, EXPLAIN.

A query is parsed, analysed and optimised by Catalyst; the engine maps table names to
views, ``$n`` to named parameters, and rewrites what its semantics have otherwise
(functions, null order, frames, whole division). Tables that DML changes are Parquet
snapshots: INSERT adds files to the current one, DELETE writes the next one and swaps the
pointer. Readers of an old snapshot keep it until ``vacuum()``.
"""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lakequill.plans import lexer, semantics
from lakequill.plans.names import rename_tables
from lakequill.sources import metadata
from lakequill.sources.registry import Registry, Table, TableNotFound, storage_uri

_NAME = r"((?:`[^`]+`|[\w]+)(?:\.(?:`[^`]+`|[\w]+)){0,2})"


def _plain(name: str) -> tuple[str, ...]:
    return tuple(a or b for a, b in re.findall(r"`([^`]+)`|(\w+)", name))


class Engine:
    def __init__(self, spark: SparkSession, registry: Registry | None = None, warehouse: str | None = None, strict: bool = False):
        """``strict``: operands of types that no rule of coercion brings together are an error, where Spark would cast them."""
        self.spark, self.strict = spark, strict
        self.registry = registry or Registry(spark)
        self._warehouse = warehouse or spark.conf.get("spark.sql.warehouse.dir")
        self._id = uuid.uuid4().hex[:8]
        self._retired: list[str] = []

    # queries

    def sql(self, text: str, params: list[Any] | None = None) -> DataFrame:
        """Run one statement. ``params`` are the values of ``$1``, ``$2``, ..., bound as typed values."""
        text = lexer.without_comments(text).rstrip("; \n")
        head = (lexer.words(text, 3) + ["", "", ""])[:3]
        match head:
            case ["EXPLAIN", *_]:
                return self.explain(re.sub(r"(?is)^\s*explain\s+", "", text), params)
            case ["CREATE", "TABLE", _]:
                return self._create_table(text, params)
            case ["CREATE", "VIEW", _] | ["CREATE", "OR", "REPLACE"]:
                return self._create_view(text)
            case ["CREATE", "SCHEMA", _]:
                self.registry.create_schema(re.sub(r"(?is)^\s*create\s+schema\s+(if\s+not\s+exists\s+)?", "", text).strip())
                return self._done()
            case ["DROP", "TABLE" | "VIEW", _]:
                return self._drop(text)
            case ["INSERT", "INTO", _]:
                return self._insert(text, params)
            case ["DELETE", "FROM", _]:
                return self._delete(text, params)
            case ["SET" | "RESET" | "SHOW", *_]:
                return self._setting(text, head)
        return self._query(text, params)

    def explain(self, text: str, params: list[Any] | None = None) -> DataFrame:
        """One row, one column ``plan``: the optimised logical plan, indented, without the numbers of columns."""
        plan = self._query(text, params)._jdf.queryExecution().optimizedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"(?m)^[ :]*(?:[+:]- )?", lambda m: "  " * (len(m[0]) // 3), plan).rstrip()
        return self.spark.createDataFrame([(plan,)], "plan string")

    def _query(self, text: str, params: list[Any] | None = None) -> DataFrame:
        text = lexer.without_comments(text)
        used = lexer.numbered_to_named(text)[1]
        if used and (not params or used[-1] > len(params)):
            raise ValueError(f"parameter ${used[-1]} has no value")

        def view_of(parts: tuple[str, ...]) -> str | None:
            if (key := metadata.key_of(parts)) is not None:
                return self._view(f"lq_{self._id}_{'_'.join(key)}", metadata.relation(self.registry, key))
            if not self.registry.has(parts):
                return None
            full = self.registry.full_name(parts)
            return self._view(f"lq_{self._id}_" + "__".join(full), self.registry.resolve(full).load())

        named = rename_tables(text, view_of)
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        session = {"CURRENT_DATABASE": quote(self.registry.catalog), "CURRENT_CATALOG": quote(self.registry.catalog), "CURRENT_SCHEMA": quote(self.registry.schema)}
        args = {f"p{n}": params[n - 1] for n in used}

        def run(sql: str) -> DataFrame:
            return self.spark.sql(sql, args=args) if used else self.spark.sql(sql)

        plain = lexer.numbered_to_named(semantics.rewritten(named, session, anti=False))[0]
        sql = lexer.numbered_to_named(semantics.rewritten(named, session))[0]
        try:
            df = run(sql)
        except AnalysisException:
            if sql == plain:
                raise
            sql = plain  # a correlated NOT IN
            df = run(sql)
        while "/" in sql and (places := semantics.whole_divisions(df, sql)):
            for place in reversed(places):
                sql = f"{sql[:place]} div {sql[place + 1 :]}"
            df = run(sql)
        if self.strict:
            semantics.check_coercions(df)
        return df

    def export(self, text: str, location: str, kind: str = "parquet", params: list[Any] | None = None, **options: str) -> None:
        """Write a query's rows to a new folder: parquet, csv (with a header), orc or json; ``compression`` and other options are the writer's."""
        if kind not in ("parquet", "csv", "orc", "json"):
            raise LookupError(f"unknown format: {kind}")
        options = ({"header": "true"} if kind == "csv" else {}) | options
        self.sql(text, params).write.options(**options).format(kind).save(storage_uri(location))

    def register_function(self, name: str, function: Any) -> None:
        """A scalar or aggregate user function (best a pandas UDF) for SQL texts."""
        self.spark.udf.register(name, function)

    def register_table_function(self, name: str, function: Any) -> None:
        """A user table function for FROM clauses."""
        self.spark.udtf.register(name, function)

    @staticmethod
    def _view(name: str, df: DataFrame) -> str:
        df.createOrReplaceTempView(name)
        return name

    def _done(self, text: str = "OK") -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    # session

    def _setting(self, text: str, head: list[str]) -> DataFrame:
        if head[0] == "SHOW":
            name = text.split(None, 1)[1].strip().lower()
            known = {"server_version": "'" + self.spark.version + "'", "search_path": f"'{self.registry.schema}'", "timezone": "current_timezone()"}
            return self.spark.sql(f"SELECT {known[name]} AS {name}") if name in known else self.spark.sql(text)
        if head[0] == "SET" and head[1] in ("SCHEMA", "SEARCH_PATH"):
            self.registry.schema = re.sub(r"(?is)^set\s+\w+\s*(=|to)?\s*", "", text).strip(" '\"")
        elif head[0] == "SET" and "=" in text and head[1].startswith("SPARK"):
            self.spark.sql(text)
        return self._done()

    # definitions

    def _folder(self, full: tuple[str, str, str], version: int) -> str:
        return f"{self._warehouse.rstrip('/')}/lakequill_{self._id}/{'/'.join(full)}/v{version}-{uuid.uuid4().hex[:8]}"

    def _store(self, name: tuple[str, ...], df: DataFrame, version: int = 0) -> None:
        folder = self._folder(self.registry.full_name(name), version)
        df.write.parquet(folder)
        schema = df.schema
        self.registry.register(name, Table(lambda: self.spark.read.schema(schema).parquet(folder), "table", snapshot=folder, version=version))

    def _create_table(self, text: str, params: list[Any] | None) -> DataFrame:
        m = re.match(rf"(?is)^create\s+table\s+(if\s+not\s+exists\s+)?{_NAME}\s*(.*)$", text)
        if not m:
            raise ValueError("CREATE TABLE needs a name")
        name, rest = _plain(m[2]), m[3].strip()
        if self.registry.has(name):
            if m[1]:
                return self._done("exists")
            raise ValueError(f"table exists: {m[2]}")
        query = re.match(r"(?is)^as\s+(.*)$", rest)
        if query:
            self._store(name, self._query(query[1], params))
        else:
            columns = re.match(r"(?s)^\((.*)\)$", rest)
            if not columns:
                raise ValueError("CREATE TABLE needs columns or AS SELECT")
            self._store(name, self.spark.createDataFrame([], self._ddl(columns[1])))
        return self._done()

    def _ddl(self, columns: str):
        """Column definitions with the engine's spellings: bare DECIMAL is (38,0), TIMESTAMP has no zone."""
        columns = re.sub(r"(?i)\bdouble\s+precision\b", "double", columns)
        columns = re.sub(r"(?i)\b(decimal|dec|numeric)\b(?!\s*\()", "decimal(38,0)", columns)
        columns = re.sub(r"(?i)\b(decimal|dec|numeric)\s*\(\s*(\d+)\s*\)", r"decimal(\2,0)", columns)
        columns = re.sub(r"(?i)\b(?:character\s+varying|varchar|text|char)\b(\s*\(\s*\d+\s*\))?", "string", columns)
        columns = re.sub(r"(?i)\b(varbinary|blob)\b", "binary", columns)
        columns = re.sub(r"(?i)\btimestamp\s+with\s+time\s+zone\b", "timestamp_ltz", columns)
        columns = re.sub(r"(?i)\btimestamp\b", "timestamp_ntz", columns)
        return self.spark.createDataFrame([], columns).schema

    def _create_view(self, text: str) -> DataFrame:
        m = re.match(rf"(?is)^create\s+(or\s+replace\s+)?view\s+{_NAME}\s*(?:\(([^)]*)\))?\s+as\s+(.*)$", text)
        if not m:
            raise ValueError("CREATE VIEW needs a name and a query")
        name, names, query = _plain(m[2]), m[3], m[4]
        if self.registry.has(name) and not m[1]:
            raise ValueError(f"table exists: {m[2]}")

        def load() -> DataFrame:
            df = self._query(query)
            return df.toDF(*(c.strip(" `") for c in names.split(","))) if names else df

        load()  # a view that can't be planned is an error now
        self.registry.register(name, Table(load, "view"))
        return self._done()

    def _drop(self, text: str) -> DataFrame:
        m = re.match(rf"(?is)^drop\s+(table|view)\s+(if\s+exists\s+)?{_NAME}$", text)
        if not m:
            raise ValueError("DROP takes one name")
        name = _plain(m[3])
        if self.registry.has(name) and (self.registry.resolve(name).kind == "view") != (m[1].lower() == "view"):
            raise ValueError(f"{m[3]} is not a {m[1].lower()}")
        found = self.registry.unregister(name, if_exists=bool(m[2]))
        if found and found.snapshot:
            self._retired.append(found.snapshot)
        return self._done()

    # changes

    def _changeable(self, name: tuple[str, ...]) -> Table:
        """The table as a snapshot; a registered DataFrame becomes one on its first change."""
        table = self.registry.resolve(name)
        if table.snapshot is None:
            if table.kind != "memory":
                raise ValueError(f"a {table.kind} relation can't be changed")
            self._store(name, table.load())
            table = self.registry.resolve(name)
        return table

    def _insert(self, text: str, params: list[Any] | None) -> DataFrame:
        m = re.match(rf"(?is)^insert\s+into\s+{_NAME}\s*(?:\(([\w\s,`]+)\)\s*(?=select|values|with))?(.*)$", text)
        if not m:
            raise ValueError("INSERT INTO needs a table and rows")
        name = _plain(m[1])
        table = self._changeable(name)
        target = table.load().schema
        rows = self._query(m[3].strip(), params)
        wanted = [c.strip(" `") for c in m[2].split(",")] if m[2] else target.fieldNames()
        if len(rows.columns) != len(wanted):
            raise ValueError(f"{len(wanted)} columns, {len(rows.columns)} values")
        rows = rows.toDF(*wanted)
        given = {c.lower(): c for c in wanted}
        values = [(f"`{given[f.name.lower()]}`" if f.name.lower() in given else "NULL") for f in target.fields]
        rows = rows.selectExpr(*(f"cast({v} AS {f.dataType.simpleString()}) AS `{f.name}`" for v, f in zip(values, target.fields)))
        rows.write.mode("append").parquet(table.snapshot)
        return self._done()

    def _delete(self, text: str, params: list[Any] | None) -> DataFrame:
        m = re.match(rf"(?is)^delete\s+from\s+{_NAME}(?:\s+where\s+(.*))?$", text)
        if not m:
            raise ValueError("DELETE FROM needs a table")
        name = _plain(m[1])
        table = self._changeable(name)
        full = ".".join(f"`{p}`" for p in self.registry.full_name(name))
        # Rows for which the predicate is false or unknown stay.
        kept = self._query(f"SELECT * FROM {full} WHERE NOT coalesce(({m[2]}), false)", params) if m[2] else table.load().limit(0)
        self._store(name, kept, table.version + 1)
        self._retired.append(table.snapshot)
        return self._done()

    def vacuum(self) -> None:
        """Remove snapshots that no name refers to; DataFrames made from them can't be read any more."""
        while self._retired:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._retired.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["Engine", "TableNotFound"]
