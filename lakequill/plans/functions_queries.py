"""Queries of the nineteen scalar functions, as texts for the engine."""

from __future__ import annotations

_PADDED = "concat(' \t', event_type, '\t ')"
_DAY = "cast(o_orderdate AS date)"

#: name -> (table, kept columns, engine expressions, DuckDB expressions)
COLUMNS: dict[str, tuple[str, list[str], dict[str, str], dict[str, str]]] = {
    "f01_upper": ("events", ["event_id"], {"v": "UPPER(event_type)"}, {"v": "upper(event_type)"}),
    "f02_lower": ("customer", ["c_custkey"], {"v": "lower(c_mktsegment)"}, {"v": "lower(c_mktsegment)"}),
    "f03_substring": ("part", ["p_partkey"], {"a": "substring(p_name, 3, 4)", "b": "SUBSTRING(p_name, -2, 3)", "c": "substring(p_name FROM 2)", "d": "substring(p_name, 2, -1)", "e": "substring(p_name, 99)"}, {"a": "substring(p_name, 3, 4)", "b": "substring(p_name, 1, 3)", "c": "substring(p_name, 2)", "d": "''", "e": "''"}),
    "f04_trim": ("events", ["event_id"], {"v": f"trim({_PADDED})"}, {"v": "event_type"}),
    "f05_ltrim": ("events", ["event_id"], {"v": f"ltrim({_PADDED})"}, {"v": "event_type || chr(9) || ' '"}),
    "f06_rtrim": ("events", ["event_id"], {"v": f"rtrim({_PADDED})"}, {"v": "' ' || chr(9) || event_type"}),
    "f07_concat": ("documents", ["doc_id"], {"v": "concat(source, '-', nullif(lang, 'de'))"}, {"v": "source || '-' || nullif(lang, 'de')"}),
    "f08_length": ("documents", ["doc_id"], {"v": "length(text)", "w": "length(nullif(lang, 'de'))"}, {"v": "length(text)", "w": "length(nullif(lang, 'de'))"}),
    "f09_replace": ("part", ["p_partkey"], {"v": "replace(p_name, 'bl', 'BL-')", "w": "replace('ab', '', '-')"}, {"v": "replace(p_name, 'bl', 'BL-')", "w": "'-a-b-'"}),
    "f10_position": ("documents", ["doc_id"], {"v": "position('the' IN text)", "w": "position('', text)"}, {"v": "position('the' IN text)", "w": "cast(1 AS bigint)"}),
    "f11_abs": ("customer", ["c_custkey"], {"v": "abs(c_acctbal)", "w": "abs(c_custkey - 100)"}, {"v": "abs(c_acctbal)", "w": "abs(c_custkey - 100)"}),
    "f12_round": ("lineitem", ["l_orderkey", "l_linenumber"], {"v": "round(l_quantity / 7, 4)", "w": "round(l_orderkey, -2)", "x": "round(2.5)"}, {"v": "round(l_quantity / 7, 4)", "w": "round(cast(l_orderkey AS double), -2)", "x": "3.0::double"}),
    "f13_ceil": ("customer", ["c_custkey"], {"v": "ceil(c_acctbal)", "w": "ceil(c_custkey)"}, {"v": "ceil(c_acctbal)", "w": "cast(c_custkey AS double)"}),
    "f14_floor": ("customer", ["c_custkey"], {"v": "floor(c_acctbal)", "w": "floor(c_custkey)"}, {"v": "floor(c_acctbal)", "w": "cast(c_custkey AS double)"}),
    "f15_mod": ("lineitem", ["l_orderkey", "l_linenumber"], {"v": "mod(-l_quantity, l_linenumber - 1)"}, {"v": "mod(-l_quantity, nullif(cast(l_linenumber - 1 AS double), 0))"}),
    "f16_power": ("part", ["p_partkey"], {"v": "power(p_size, 2)", "w": "power(2, -2)"}, {"v": "power(cast(p_size AS double), 2.0::double)", "w": "0.25::double"}),
    "f17_extract": ("orders", ["o_orderkey"], {"y": f"extract(YEAR FROM {_DAY})", "m": f"EXTRACT(MONTH FROM {_DAY})", "d": "extract(DAY FROM o_orderdate)"}, {"y": "extract(YEAR FROM o_orderdate)", "m": "extract(MONTH FROM o_orderdate)", "d": "extract(DAY FROM o_orderdate)"}),
    "f18_current_date": ("region", ["r_regionkey"], {"v": "CURRENT_DATE"}, {"v": "cast(now() AT TIME ZONE 'UTC' AS date)"}),
    "f19_date_trunc": ("orders", ["o_orderkey"], {"y": f"date_trunc('year', {_DAY})", "m": f"date_trunc('MONTH', {_DAY})", "d": f"date_trunc('day', {_DAY})"}, {"y": "date_trunc('year', o_orderdate)::date", "m": "date_trunc('month', o_orderdate)::date", "d": "o_orderdate::date"}),
}


def _select(name: str, expressions: dict[str, str]) -> str:
    source, keep = COLUMNS[name][:2]
    return f"SELECT {', '.join([*keep, *(f'{x} AS {n}' for n, x in expressions.items())])} FROM {source}"


#: name -> (engine text, DuckDB text)
SQL: dict[str, tuple[str, str | None]] = {name: (_select(name, mine), _select(name, duck)) for name, (_, _, mine, duck) in COLUMNS.items()}
