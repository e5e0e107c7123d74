"""Comparisons with the engine's null rules, and their left-to-right fold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str | None) -> bool:
    return kind is not None and (kind in NUMERIC or kind.startswith("decimal"))


def literal(value: object, kind: str | None = None) -> Column:
    """A numeric string becomes a number beside a numeric column."""
    if isinstance(value, str) and is_numeric(kind):
        try:
            value = float(value) if "." in value else int(value)
        except ValueError:
            pass
    if isinstance(value, (list, dict)):
        raise TypeError(f"not a scalar: {value!r}")
    return F.lit(value)


def compare(left: Column, op: str, value: object, kind: str | None = None) -> Column:
    """= and != treat null as a value (a missing field differs from any value); order comparisons with null are false."""
    right = literal(value, kind)
    if isinstance(value, str) and is_numeric(kind) and not isinstance(literal_value(value), (int, float)):
        left = left.cast("string")
    if op in ("=", "==", "IS"):
        return left.eqNullSafe(right)
    if op == "!=":
        return ~left.eqNullSafe(right)
    ordered = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
    return F.coalesce(ordered, F.lit(False))


def literal_value(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def fold(parts: Iterable[tuple[str, Column]]) -> Column:
    """((p1 OR p2) AND p3): no precedence, strictly from the left; the first connective is ignored."""
    out = None
    for connective, part in parts:
        out = part if out is None else (out | part if connective == "OR" else out & part)
    return F.lit(True) if out is None else out


def any_element(column: Column, kind: str, op: str, value: float) -> Column:
    """Record-engine comparison: numbers only, true if any element of an array holds."""
    if kind.startswith("array"):
        return F.coalesce(F.exists(column, lambda x: F.coalesce(_plain(x, op, value), F.lit(False))), F.lit(False))
    return F.coalesce(_plain(column, op, value), F.lit(False))


def _plain(x: Column, op: str, value: float) -> Column:
    return {"=": x == value, "!=": x != value, ">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value}[op]
