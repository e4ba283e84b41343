"""Flows of pairs (k, v) and of groups (k, vs)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.flow import Flow
from millrace.operators.aggregate import Aggregator, aggregate_by_key, reducing
from millrace.operators.reducers import Reducer, reduce_array, reduced

Fn = Callable[[Column], Any]


def _lit(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class KeyedFlow(Flow):
    """Columns k and v. Null keys group together and never join."""

    def _of(self, df: DataFrame) -> KeyedFlow:
        return KeyedFlow(df)

    def map_values(self, f: Fn) -> KeyedFlow:
        return self._of(self.df.select("k", _lit(f(F.col("v"))).alias("v")))

    def map_key(self, f: Fn) -> KeyedFlow:
        return self._of(self.df.select(_lit(f(F.col("k"))).alias("k"), "v"))

    map_keys = map_key

    def swap(self) -> KeyedFlow:
        return self._of(self.df.select(F.col("v").alias("k"), F.col("k").alias("v")))

    def find_by_key(self, f: Fn) -> KeyedFlow:
        """Catalyst moves a condition on k below the groupings it passes."""
        return self._of(self.df.where(f(F.col("k"))))

    def find_by_value(self, f: Fn) -> KeyedFlow:
        return self._of(self.df.where(f(F.col("v"))))

    find_values = find_by_value

    def _kind(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    def reduce_by_key(self, how: Reducer) -> KeyedFlow:
        """how: a named reducer, or an associative, commutative Python function of two values; either is combined before the shuffle."""
        if callable(how):
            return self._of(aggregate_by_key(self.df, reducing(how), self._kind()))
        return self._of(self.df.groupBy("k").agg(reduced(F.col("v"), how).alias("v")))

    def fold_by_key(self, zero: Any, f: Callable[[Any, Any], Any]) -> KeyedFlow:
        """``f(zero, reduction of a key's values by f)``."""
        return self._of(aggregate_by_key(self.df, reducing(f, lambda s: f(zero, s[0]) if s else zero), self._kind()))

    def aggregate_with(self, agg: Aggregator, kind: str) -> KeyedFlow:
        """A user's aggregator over the values of each key, of the type ``kind``."""
        return self._of(aggregate_by_key(self.df, agg, kind))

    def aggregate_by_key(self, **named: tuple[str, Fn]) -> Flow:
        """(k, several reductions of v)."""
        return Flow(self.df.groupBy("k").agg(*[reduced(_lit(f(F.col("v"))), how).alias(n) for n, (how, f) in named.items()]))

    def group_by_key(self) -> GroupedFlow:
        return GroupedFlow(self.df.groupBy("k").agg(F.collect_list("v").alias("vs")), self.df.select("k", "v", F.lit(True).alias("held")))

    def join_by_key(self, other: KeyedFlow, how: str = "inner") -> KeyedFlow:
        """(k, v) with v a struct ``left``, ``right``; Spark picks the join by the sizes it sees. how: also left, right, full."""
        a, b = self.df.select("k", F.col("v").alias("left")), other.df.select("k", F.col("v").alias("right"))
        return self._of(a.join(b, "k", how).select("k", F.struct("left", "right").alias("v")))

    join_by_key_opt = join_by_key

    def semi_join_by_key(self, other: KeyedFlow, anti: bool = False) -> KeyedFlow:
        return self._of(self.df.join(other.df.select("k"), "k", "left_anti" if anti else "left_semi"))

    def cogroup_by_key(self, other: KeyedFlow) -> GroupedFlow:
        """(k, left, right), the keys of either side; null keys of the two sides meet, as when grouping."""
        # both sides in one grouping, so one shuffle; values are wrapped, as lists leave nulls out
        a = self.df.select("k", F.struct("v").alias("a"), F.lit(None).cast(other.df.select(F.struct("v")).schema[0].dataType).alias("b"))
        b = other.df.select("k", F.lit(None).cast(a.schema["a"].dataType).alias("a"), F.struct("v").alias("b"))
        g = a.union(b).groupBy("k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
        return GroupedFlow(g.select("k", F.transform("a", lambda x: x["v"]).alias("left"), F.transform("b", lambda x: x["v"]).alias("right")))

    def cogroup_apply(self, other: KeyedFlow, f, schema: str) -> Flow:
        """An opaque function over the pandas frames of both sides of each key."""
        return Flow(self.df.groupBy("k").cogroup(other.df.groupBy("k")).applyInPandas(f, schema))


class GroupedFlow(Flow):
    """Columns k and vs (or, from a cogroup, k, left and right).

    ``pairs`` (k, v, held), where it is known, are the values before they were grouped: what is reduced at last by name is reduced from
    these, and no list is made.
    """

    def __init__(self, df: DataFrame, pairs: DataFrame | None = None) -> None:
        super().__init__(df)
        self.pairs = pairs

    def _of(self, df: DataFrame) -> GroupedFlow:
        return GroupedFlow(df)

    def _both(self, df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> GroupedFlow:
        return GroupedFlow(df, f(self.pairs) if self.pairs is not None else None)

    def find_by_key(self, f: Fn) -> GroupedFlow:
        return self._both(self.df.where(f(F.col("k"))), lambda p: p.where(f(F.col("k"))))

    def map_values_by_key(self, f: Fn) -> GroupedFlow:
        """Every value of every group mapped."""
        return self._both(self.df.select("k", F.transform("vs", lambda x: _lit(f(x))).alias("vs")), lambda p: p.select("k", _lit(f(F.col("v"))).alias("v"), "held"))

    def find_values_by_key(self, f: Fn) -> GroupedFlow:
        """Values that meet a condition; a key whose list empties stays."""
        return self._both(self.df.select("k", F.filter("vs", f).alias("vs")), lambda p: p.select("k", "v", (F.col("held") & F.coalesce(f(F.col("v")), F.lit(False))).alias("held")))

    def reduce_values(self, how: Reducer) -> KeyedFlow:
        """how: a named reducer, or a function of two columns that folds each list."""
        if self.pairs is not None and how in ("sum", "min", "max", "count", "avg", "product"):
            return KeyedFlow(self.pairs.groupBy("k").agg(reduced(F.when(F.col("held"), F.col("v")), how).alias("v")))
        return KeyedFlow(self.df.select("k", reduce_array(F.col("vs"), how).alias("v")))

    def ungroup(self) -> KeyedFlow:
        return KeyedFlow(self.df.select("k", F.explode("vs").alias("v")))
