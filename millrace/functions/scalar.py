"""Scalar functions with the JVM's string semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_trimmed(c: Column, pattern: str) -> Column:
    """Split without the empty strings at the end, as the JVM's split drops them; an empty text gives one empty string."""
    parts = F.split(c, pattern)
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(c == "", F.array(F.lit(""))).otherwise(F.slice(parts, F.lit(1), last))


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches, a line break at its end included."""
    return c.rlike(rf"\A(?:{pattern})\z")


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def suffix_from(c: Column, at: int) -> Column:
    """From a position counted from 0."""
    return F.substring(c, at + 1, 2**31 - 1)


def head(c: Column) -> Column:
    return F.substring(c, 1, 1)


def to_number(c: Column, kind: str = "double") -> Column:
    """Null where the text is no number."""
    return c.try_cast(kind)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dropped(c: Column, left: int, right: int = 0) -> Column:
    """An array without its first and last elements."""
    return F.slice(c, F.lit(left + 1), F.greatest(F.size(c) - left - right, F.lit(0)))
