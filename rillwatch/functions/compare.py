"""Condition operators as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch.schema import is_number

_ORDERED = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def _as_float(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _comparable(dtype: T.DataType, value) -> bool:
    """Numbers only equal numbers, text only equals text."""
    return is_number(dtype) == isinstance(value, (int, float)) and not isinstance(value, bool)


def compare(actual: Column, dtype: T.DataType, operator: str, expected) -> Column:
    """True or false, never NULL: unknown operators and values that are no numbers give false."""
    if operator in ("eq", "ne"):
        same = actual == F.lit(expected) if _comparable(dtype, expected) else F.lit(False)
        return F.coalesce(same if operator == "eq" else ~same, F.lit(False))
    if operator == "in":
        usable = [v for v in expected if _comparable(dtype, v)] if isinstance(expected, (list, tuple)) else []
        return F.coalesce(actual.isin(usable), F.lit(False)) if usable else F.lit(False)
    bound = _as_float(expected)
    if operator not in _ORDERED or bound is None:
        return F.lit(False)
    return F.coalesce(_ORDERED[operator](actual.try_cast("double"), F.lit(bound)), F.lit(False))
