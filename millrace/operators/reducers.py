"""Reducers by name, lowered to built-in aggregates that Spark combines on the map side, and folds of arrays.

Opaque functions of two values are reduced by ``operators.aggregate``; here a function of two columns folds an array that stands in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Reducer = str | Callable

NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
    "product": F.product,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "first": F.first,
    "last": F.last,
    "concat": lambda c: F.array_join(F.array_sort(F.collect_list(c)), ""),
    "collect": F.collect_list,
    "distinct": F.collect_set,
}


def fold_values(values: Column, f: Callable[[Column, Column], Column], zero: Column | None = None) -> Column:
    """``f`` over an array: from ``zero``, or from its first element (null for an empty array)."""
    if zero is not None:
        return F.aggregate(values, zero, f)
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), f))


#: named reducers as functions of two columns, and what they give for no values (null where there is no such value)
BOTH: dict[str, tuple[Callable[[Column, Column], Column], object]] = {
    "sum": (lambda a, b: a + b, 0),
    "product": (lambda a, b: a * b, 1),
    "min": (lambda a, b: F.least(a, b), None),
    "max": (lambda a, b: F.greatest(a, b), None),
    "count": (lambda a, b: a + b, 0),
    "bool_and": (lambda a, b: a & b, True),
    "bool_or": (lambda a, b: a | b, False),
    "bit_and": (lambda a, b: a.bitwiseAND(b), -1),
    "bit_or": (lambda a, b: a.bitwiseOR(b), 0),
    "bit_xor": (lambda a, b: a.bitwiseXOR(b), 0),
    "concat": (lambda a, b: F.concat(a, b), ""),
}


def reduced(value: Column, how: str) -> Column:
    """The aggregate that ``how`` names."""
    if callable(how):
        raise ValueError("functions are reduced by themselves: reduce, fold, reduce_by_key, fold_by_key or aggregate")
    if how not in NAMED:
        raise ValueError(f"no reducer {how!r}; there are {', '.join(sorted(NAMED))}")
    return NAMED[how](value)


def folded(value: Column, how: str, zero: Column) -> Column:
    """The aggregate combined with ``zero``, which stands first."""
    if how not in BOTH:
        raise ValueError(f"{how!r} can't be combined with a zero; {', '.join(sorted(BOTH))} can")
    both, _ = BOTH[how]
    total = reduced(value, how)
    return F.when(total.isNull(), zero).otherwise(both(zero, total))


def reduce_array(values: Column, how: Reducer) -> Column:
    """The same over an array in one row."""
    if callable(how):
        return fold_values(values, how)
    if how == "min":
        return F.array_min(values)
    if how == "max":
        return F.array_max(values)
    if how == "count":
        return F.size(values).cast("long")
    if how == "sum":
        return fold_values(values, lambda a, b: a + b)
    if how == "product":
        return fold_values(values, lambda a, b: a * b)
    if how == "avg":
        return F.when(F.size(values) > 0, fold_values(F.transform(values, lambda x: x.cast("double")), lambda a, b: a + b) / F.size(values))
    if how in ("first", "last"):
        return F.get(values, F.lit(0) if how == "first" else F.size(values) - 1)
    raise ValueError(f"no array reducer {how!r}")
