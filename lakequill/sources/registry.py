"""Catalogs of schemas of tables, and the sources behind them."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CONFIG_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "date32": T.DateType(), "timestamp": T.TimestampNTZType(),
}
SCHEMES = {"": "file", "file": "file", "s3": "s3a", "s3a": "s3a", "gs": "gs", "abfss": "abfss", "az": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


#: Path -> (length and time of the file, its schema).
_SCHEMAS: dict[str, tuple[tuple[int, int], T.StructType]] = {}


class TableNotFound(LookupError):
    pass


def storage_uri(uri: str, account: str | None = None) -> str:
    """The path for Spark's readers; ``s3://`` and ``az://`` take the schemes of their Hadoop connectors.

    ``az://container/x`` names no storage account, so it needs ``account``.
    """
    found = urlparse(uri)
    if found.scheme not in SCHEMES:
        raise ValueError(f"unsupported storage scheme: {found.scheme}")
    if found.scheme == "az" and "@" not in found.netloc:
        if not account:
            raise ValueError(f"{uri} needs a storage account")
        return f"abfss://{found.netloc}@{account}.dfs.core.windows.net{found.path}"
    return uri if not found.scheme else SCHEMES[found.scheme] + uri[len(found.scheme) :]


@dataclass
class Table:
    """A named relation: ``load`` makes its DataFrame, so that a file table sees new files."""

    load: Callable[[], DataFrame]
    kind: str
    properties: dict[str, str] = field(default_factory=dict)
    #: Folder of the current snapshot of a table that DML can change.
    snapshot: str | None = None
    version: int = 0


class Registry:
    """Names of one to three parts, resolved by the current catalog and schema.

    Table names are case-sensitive, as a map's keys are; column names are not.
    """

    def __init__(self, spark: SparkSession, catalog: str = "main", schema: str = "default"):
        self.spark, self.catalog, self.schema = spark, catalog, schema
        #: Account of ``az://`` locations.
        self.azure_account: str | None = None
        self._tables: dict[tuple[str, str, str], Table] = {}
        self._schemas: set[tuple[str, str]] = {(catalog, schema)}
        self._connectors: dict[str, Callable[[str, dict[str, str]], Table]] = {"parquet": self._parquet, "csv": self._csv, "orc": self._plain("orc"), "json": self._plain("json"), "hive": self._hive}

    # names

    def full_name(self, name: str | tuple[str, ...]) -> tuple[str, str, str]:
        parts = tuple(name.split(".")) if isinstance(name, str) else name
        if not 1 <= len(parts) <= 3 or not all(parts):
            raise ValueError(f"a table name has one to three parts: {name}")
        return ((self.catalog, self.schema)[: 3 - len(parts)] + parts)[:3]

    def register(self, name: str | tuple[str, ...], table: Table) -> None:
        key = self.full_name(name)
        self._schemas.add(key[:2])
        self._tables[key] = table

    def create_schema(self, name: str) -> None:
        self._schemas.add((self.catalog, *name.split("."))[-2:])

    def unregister(self, name: str | tuple[str, ...], if_exists: bool = False) -> Table | None:
        found = self._tables.pop(self.full_name(name), None)
        if found is None and not if_exists:
            raise TableNotFound(f"table not found: {name}")
        return found

    def resolve(self, name: str | tuple[str, ...]) -> Table:
        try:
            return self._tables[self.full_name(name)]
        except KeyError:
            raise TableNotFound(f"table not found: {name}") from None

    def has(self, name: str | tuple[str, ...]) -> bool:
        return self.full_name(name) in self._tables

    def tables(self) -> dict[tuple[str, str, str], Table]:
        return dict(self._tables)

    def schemas(self) -> list[tuple[str, str]]:
        return sorted(self._schemas)

    # sources

    def connector(self, name: str, make: Callable[[str, dict[str, str]], Table]) -> None:
        """Add a kind of source: ``make(location, options)``."""
        self._connectors[name] = make

    def register_source(self, name: str, kind: str, location: str, **options: str) -> None:
        if kind not in self._connectors:
            raise LookupError(f"unknown connector: {kind}")
        self.register(name, self._connectors[kind](location, options))

    def register_dataframe(self, name: str, df: DataFrame) -> None:
        self.register(name, Table(lambda: df, "memory"))

    def register_csv(self, name: str, location: str, schema: T.StructType | str) -> None:
        self.register(name, self._csv(location, {"schema": schema}))

    def _parquet(self, location: str, options: dict[str, str]) -> Table:
        path = storage_uri(location, self.azure_account)
        return Table(lambda: self._opened(path), "parquet", {"location": path})

    def _opened(self, path: str) -> DataFrame:
        """A Parquet table. The schema of one file is looked up once for as long as the file stays the same; a folder's each time."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        try:
            status = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
        except Py4JJavaError:  # a pattern, or nothing: Spark's reader knows
            return self.spark.read.parquet(path)
        if not status.isFile():
            return self.spark.read.parquet(path)
        version = (status.getLen(), status.getModificationTime())
        known = _SCHEMAS.get(path)
        if known is None or known[0] != version:
            df = self.spark.read.parquet(path)
            _SCHEMAS[path] = (version, df.schema)
            return df
        return self.spark.read.schema(known[1]).parquet(path)

    def _csv(self, location: str, options: dict[str, str]) -> Table:
        if not options.get("schema"):
            raise ValueError("a CSV table needs its schema; nothing is inferred")
        path, schema = storage_uri(location, self.azure_account), options["schema"]
        return Table(lambda: self.spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path), "csv", {"location": path})

    def _plain(self, kind: str) -> Callable[[str, dict[str, str]], Table]:
        def make(location: str, options: dict[str, str]) -> Table:
            path = storage_uri(location, self.azure_account)
            reader = lambda: self.spark.read.schema(options["schema"]) if options.get("schema") else self.spark.read
            return Table(lambda: getattr(reader(), kind)(path), kind, {"location": path})

        return make

    def _hive(self, location: str, options: dict[str, str]) -> Table:
        """A table of the session's metastore (``database.table``); the session must have Hive support."""
        return Table(lambda: self.spark.table(location), "hive", {"location": location})

    def mount_hive_database(self, database: str, schema: str | None = None) -> list[str]:
        """Register every table of a metastore database under a schema; they are read when used."""
        names = [t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary]
        for n in names:
            self.register((self.catalog, schema or database, n), self._hive(f"{database}.{n}", {}))
        return names

    # configuration

    def load_config(self, path: str | Path, environment: dict[str, str] | None = None) -> None:
        """Tables and defaults from a TOML file::

            catalog = "main"
            schema = "default"
            [storage]
            azure_account = "name"  # of az:// locations
            "fs.s3a.endpoint" = "http://host:9000"  # and any other option of the Hadoop connectors
            [[tables]]
            name = "events"
            format = "csv"          # or parquet
            path = "s3://bucket/events.csv"
            columns = [{name = "id", type = "int64", nullable = false}]

        LAKEQUILL_CATALOG and LAKEQUILL_SCHEMA in ``environment`` win over the file.
        """
        with open(path, "rb") as file:
            config = tomllib.load(file)
        environment = environment or {}
        self.catalog = environment.get("LAKEQUILL_CATALOG", config.get("catalog", self.catalog))
        self.schema = environment.get("LAKEQUILL_SCHEMA", config.get("schema", self.schema))
        self._schemas.add((self.catalog, self.schema))
        storage = dict(config.get("storage", {}))
        self.azure_account = storage.pop("azure_account", self.azure_account)
        for name, value in storage.items():
            self.spark._jsc.hadoopConfiguration().set(name, str(value))
        for t in config.get("tables", []):
            options = {}
            if t.get("columns"):
                options["schema"] = T.StructType([T.StructField(c["name"], CONFIG_TYPES[c["type"]], c.get("nullable", True)) for c in t["columns"]])
            self.register_source(t["name"], t["format"], t["path"], **options)
