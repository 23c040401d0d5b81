"""information_schema and pg_catalog as relations made from a registry; predicates on them work.

Only the asked relation is made, and tables are opened only for those that list columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakequill.sources.registry import Registry, Table

#: The wire protocol's types: name, object identifier, length, kind; fixed values.
PG_TYPES = (
    ("bool", 16, 1, "b"), ("bytea", 17, -1, "b"), ("int8", 20, 8, "b"), ("int2", 21, 2, "b"), ("int4", 23, 4, "b"), ("text", 25, -1, "b"),
    ("float4", 700, 4, "b"), ("float8", 701, 8, "b"), ("varchar", 1043, -1, "b"), ("date", 1082, 4, "b"), ("timestamp", 1114, 8, "b"),
    ("timestamptz", 1184, 8, "b"), ("numeric", 1700, -1, "b"), ("name", 19, 64, "b"), ("oid", 26, 4, "b"), ("int2vector", 22, -1, "b"),
)
#: Spark's types as the wire protocol's.
OF_SPARK = {"boolean": "bool", "binary": "bytea", "bigint": "int8", "smallint": "int2", "tinyint": "int2", "int": "int4", "string": "text", "float": "float4", "double": "float8", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "decimal": "numeric"}
_OID = {name: oid for name, oid, _, _ in PG_TYPES}
_LENGTH = {name: length for name, _, length, _ in PG_TYPES}

Key = tuple[str, str]


def _pg_name(t: T.DataType) -> str:
    return OF_SPARK.get(t.simpleString().split("(")[0].split("<")[0], "text")


def _oid(*parts: str) -> int:
    """The same number for a name each time, beyond those of the types."""
    return 16384 + zlib.crc32(".".join(parts).encode())


def _tables(registry: Registry) -> list[tuple[tuple[str, str, str], Table]]:
    return sorted(registry.tables().items())


def _columns(registry: Registry) -> list[tuple[tuple[str, str, str], int, T.StructField]]:
    return [(key, n + 1, f) for key, t in _tables(registry) for n, f in enumerate(t.load().schema.fields)]


def _kind(t: Table) -> str:
    return "VIEW" if t.kind == "view" else "BASE TABLE"


#: Relation -> (its columns, its rows).
RELATIONS: dict[Key, tuple[str, Callable[[Registry], list[tuple]]]] = {
    ("information_schema", "schemata"): ("catalog_name string, schema_name string", lambda r: [(c, s) for c, s in r.schemas()]),
    ("information_schema", "tables"): ("table_catalog string, table_schema string, table_name string, table_type string", lambda r: [(*k, _kind(t)) for k, t in _tables(r)]),
    ("information_schema", "columns"): (
        "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string",
        lambda r: [(*k, f.name, n, "YES" if f.nullable else "NO", f.dataType.simpleString()) for k, n, f in _columns(r)],
    ),
    ("pg_catalog", "pg_type"): (
        "oid bigint, typname string, typnamespace bigint, typlen bigint, typtype string, typbasetype bigint, typnotnull boolean",
        lambda r: [(oid, name, _oid("pg_catalog"), length, kind, 0, False) for name, oid, length, kind in PG_TYPES],
    ),
    ("pg_catalog", "pg_namespace"): ("oid bigint, nspname string", lambda r: [(_oid(s), s) for s in sorted({"pg_catalog", "information_schema"} | {s for _, s in r.schemas()})]),
    ("pg_catalog", "pg_database"): ("oid bigint, datname string", lambda r: [(_oid(c), c) for c in sorted({c for c, _ in r.schemas()})]),
    ("pg_catalog", "pg_class"): (
        "oid bigint, relname string, relnamespace bigint, relkind string, relowner bigint, relhasindex boolean",
        lambda r: [(_oid(*k), k[2], _oid(k[1]), "v" if t.kind == "view" else "r", 10, False) for k, t in _tables(r)],
    ),
    ("pg_catalog", "pg_attribute"): (
        "attrelid bigint, attname string, atttypid bigint, attnum int, attlen bigint, attnotnull boolean, atttypmod int, attisdropped boolean",
        lambda r: [(_oid(*k), f.name, _OID[_pg_name(f.dataType)], n, _LENGTH[_pg_name(f.dataType)], not f.nullable, -1, False) for k, n, f in _columns(r)],
    ),
}


def key_of(parts: tuple[str, ...]) -> Key | None:
    """The relation that a dotted name means; pg_ names need no schema."""
    schema, name = (parts[-2] if len(parts) > 1 else "pg_catalog").lower(), parts[-1].lower()
    return (schema, name) if (schema, name) in RELATIONS else None


def relation(registry: Registry, key: Key) -> DataFrame:
    """The relation's rows now; they describe names only, so they are few."""
    columns, rows = RELATIONS[key]
    return registry.spark.createDataFrame(rows(registry), columns)
