"""The nineteen scalar functions as column builders; null in, null out.

Where Spark's own function differs at an edge (negative starts, Unicode blanks, result
types), the builder states the difference in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float


def _c(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def upper(s: ColumnLike) -> Column:
    return F.upper(_c(s))


def lower(s: ColumnLike) -> Column:
    return F.lower(_c(s))


def substring(s: ColumnLike, start: ColumnLike, length: ColumnLike | None = None) -> Column:
    """Characters from 1; a start below 1 is 1 (Spark counts it from the end), a negative length 0."""
    first = F.greatest(_c(start).cast("int"), F.lit(1))
    first = F.when(_c(start).isNull(), None).otherwise(first)
    many = F.length(_c(s)) if length is None else F.when(_c(length).isNull(), None).otherwise(F.greatest(_c(length).cast("int"), F.lit(0)))
    return F.substring(_c(s), first, many)


def trim(s: ColumnLike) -> Column:
    """All Unicode white space at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def ltrim(s: ColumnLike) -> Column:
    return F.regexp_replace(_c(s), r"(?U)^\s+", "")


def rtrim(s: ColumnLike) -> Column:
    return F.regexp_replace(_c(s), r"(?U)\s+$", "")


def concat(*parts: ColumnLike) -> Column:
    return F.concat(*map(_c, parts))


def length(s: ColumnLike) -> Column:
    """Code points, as BIGINT."""
    return F.length(_c(s)).cast("bigint")


def replace(s: ColumnLike, old: ColumnLike, new: ColumnLike) -> Column:
    """All occurrences; an empty ``old`` puts ``new`` between all characters and at both ends."""
    between = F.concat(_c(new), F.array_join(F.split(_c(s), ""), "\u0000"), F.when(F.length(_c(s)) > 0, _c(new)).otherwise(F.lit("")))
    return F.when(_c(old) == "", F.replace(between, F.lit("\u0000"), _c(new))).otherwise(F.replace(_c(s), _c(old), _c(new)))


def position(sub: ColumnLike, s: ColumnLike) -> Column:
    """1-based, 0 if absent, 1 for an empty ``sub``; BIGINT."""
    return F.position(_c(sub), _c(s)).cast("bigint")


def abs_(x: ColumnLike) -> Column:
    return F.abs(_c(x))


def round_(x: ColumnLike, digits: int | None = 0) -> Column:
    """Half away from zero, DOUBLE; null digits are 0."""
    return F.round(_c(x).cast("double"), digits or 0)


def ceil(x: ColumnLike) -> Column:
    return F.ceil(_c(x)).cast("double")


def floor(x: ColumnLike) -> Column:
    return F.floor(_c(x)).cast("double")


def mod(a: ColumnLike, b: ColumnLike) -> Column:
    """Sign of the dividend; null where ``b`` is 0; DOUBLE."""
    return F.try_mod(_c(a).cast("double"), _c(b).cast("double"))


def power(a: ColumnLike, b: ColumnLike) -> Column:
    return F.pow(_c(a).cast("double"), _c(b).cast("double"))


def extract(field: str, d: ColumnLike) -> Column:
    """YEAR, MONTH, DAY of dates; HOUR, MINUTE, SECOND of timestamps; BIGINT."""
    if field.upper() not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
        raise ValueError(f"unsupported EXTRACT field: {field}")
    return F.extract(F.lit(field.upper()), _c(d)).cast("bigint")


def current_date() -> Column:
    """The UTC day: sessions of this library run in UTC."""
    return F.current_date()


def date_trunc(field: str, d: ColumnLike) -> Column:
    """A DATE for YEAR, MONTH, DAY; a timestamp for finer fields."""
    field = field.upper()
    if field == "DAY":
        return _c(d).cast("date")
    if field in ("YEAR", "MONTH"):
        return F.trunc(_c(d).cast("date"), field)
    if field in ("HOUR", "MINUTE", "SECOND"):
        return F.date_trunc(field, _c(d))
    raise ValueError(f"unsupported DATE_TRUNC field: {field}")


class FunctionRegistry:
    """Functions by case-insensitive name; ``register`` adds one's own builders."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, build: Callable[..., Column]) -> None:
        self._known[name.lower()] = build

    def get(self, name: str) -> Callable[..., Column]:
        try:
            return self._known[name.lower()]
        except KeyError:
            raise LookupError(f"unknown scalar function: {name}") from None

    def names(self) -> list[str]:
        return sorted(self._known)


def default_registry() -> FunctionRegistry:
    found = FunctionRegistry()
    for name, build in {
        "upper": upper, "lower": lower, "substring": substring, "trim": trim, "ltrim": ltrim, "rtrim": rtrim,
        "concat": concat, "length": length, "replace": replace, "position": position, "abs": abs_, "round": round_,
        "ceil": ceil, "floor": floor, "mod": mod, "power": power, "extract": extract, "current_date": current_date,
        "date_trunc": date_trunc,
    }.items():
        found.register(name, build)
    return found
