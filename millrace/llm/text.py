"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java regex classes; the complement of a word.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; other letters may be folded, but never to or from ASCII."""
    # the only letters outside ASCII whose lower case holds ASCII: Kelvin sign and dotted capital I
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def words(text: Column) -> Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words ``words`` finds."""
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    return let(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda a: (F.size(a) - empty(F.get(a, F.lit(0))) - F.when(F.size(a) > 1, empty(F.get(a, F.size(a) - 1))).otherwise(0)).cast("long"))


def prefix_sums(a: Column) -> Column:
    """Sums of an array of longs up to each element, by doubling: n log n steps."""

    def step(acc: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k - 1).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0).cast("long"), shift), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - shift, F.lit(0)))), lambda x, y: x + F.coalesce(y, F.lit(0)))

    passes = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(a))), F.lit(1)).cast("int"))
    return let(a, lambda v: F.when(F.size(v) > 1, F.slice(F.aggregate(passes, v, step), F.lit(1), F.size(v))).otherwise(v))
