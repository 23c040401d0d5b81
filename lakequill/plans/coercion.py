"""Implicit coercions of the strict binder: which types meet in which, and what only literals may do."""

from __future__ import annotations

from pyspark.sql import types as T

#: Precision with which an integer meets a decimal.
WHOLE = {T.IntegerType: 10, T.LongType: 19}
MOST_DIGITS = 38


class TypeMismatch(TypeError):
    """No rule leads from one type to the other."""


def _decimal(t: T.DataType) -> T.DecimalType | None:
    if isinstance(t, T.DecimalType):
        return t
    digits = WHOLE.get(type(t))
    return T.DecimalType(digits, 0) if digits else None


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both meet; null meets anything."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    floats = kinds & {T.FloatType, T.DoubleType}
    whole_or_decimal = {T.IntegerType, T.LongType, T.DecimalType}
    if kinds == {T.IntegerType, T.LongType}:
        return T.LongType()
    if floats and kinds <= floats | whole_or_decimal:
        return T.DoubleType()
    if T.DecimalType in kinds and kinds <= whole_or_decimal:
        x, y = _decimal(a), _decimal(b)
        scale = max(x.scale, y.scale)
        return T.DecimalType(min(MOST_DIGITS, max(x.precision - x.scale, y.precision - y.scale) + scale), scale)
    raise TypeMismatch(f"{a.simpleString()} does not meet {b.simpleString()}")


def coercible(source: T.DataType, target: T.DataType, literal: bool = False) -> bool:
    """Whether a value of ``source`` may stand where ``target`` is wanted."""
    if source == target or isinstance(source, T.NullType):
        return True
    if isinstance(source, T.StringType) and isinstance(target, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return literal
    try:
        return supertype(source, target) == target
    except TypeMismatch:
        return False
