"""Flow: a functional, collection-style view of a DataFrame.

A Flow is lazy and immutable. Functions are given as column expressions, names of columns, or functions from the Flow's columns
to column expressions (``lambda r: r.l_quantity > 45``), so Catalyst sees them; opaque Python functions go to the
``*_partitions`` methods, which run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.operators.aggregate import Aggregator, aggregate_all, reducing
from millrace.operators.reducers import Reducer, folded, reduced
from millrace.tables import stored

if TYPE_CHECKING:
    from millrace.operators.keyed import GroupedFlow, KeyedFlow

Expr = str | Column | Callable[["Columns"], Any]
_background = ThreadPoolExecutor(max_workers=8, thread_name_prefix="millrace")


class Columns:
    """Attribute and item access to the columns of one DataFrame."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._df[name]

    def __getitem__(self, name: str) -> Column:
        return self._df[name]


class Flow:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # --- expressions

    def _c(self, e: Expr) -> Column:
        if callable(e) and not isinstance(e, Column):
            e = e(Columns(self.df))
        return F.col(e) if isinstance(e, str) else e if isinstance(e, Column) else F.lit(e)

    def _of(self, df: DataFrame) -> Flow:
        return Flow(df)

    # --- projection, filter

    def map(self, *exprs: Expr, **named: Expr) -> Flow:
        """A row for each row, with the columns given."""
        return Flow(self.df.select(*[self._c(e) for e in exprs], *[self._c(e).alias(n) for n, e in named.items()]))

    apply = map

    def flat_map(self, expr: Expr, name: str = "value", keep: Sequence[str] = ()) -> Flow:
        """A row for each element of an array expression; none for null or empty."""
        return Flow(self.df.select(*keep, F.explode(self._c(expr)).alias(name)))

    def flatten(self, column: str, name: str = "value", keep: Sequence[str] = ()) -> Flow:
        """Nested to flat: arrays of arrays first become arrays, then rows."""
        from pyspark.sql.types import ArrayType

        kind = self.df.schema[column].dataType
        nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
        return self.flat_map(F.flatten(column) if nested else F.col(column), name, keep)

    def filter(self, condition: Expr) -> Flow:
        return self._of(self.df.where(condition if isinstance(condition, str) else self._c(condition)))

    find_by = filter

    def map_partitions(self, f: Callable[[Iterator[Any]], Iterator[Any]], schema: str) -> Flow:
        """``f`` from an iterator of pandas frames to another, once a partition."""
        return Flow(self.df.mapInPandas(f, schema))

    def map_partitions_with_index(self, f: Callable[[int, Iterator[Any]], Iterator[Any]], schema: str) -> Flow:
        """The same with the partition's number."""

        def run(frames):
            from pyspark import TaskContext

            return f(TaskContext.get().partitionId(), frames)

        return Flow(self.df.mapInPandas(run, schema))

    def zip_with_index(self, *order: str | Column, name: str = "idx") -> Flow:
        """Numbers from 0 in the order given, or else in that of the partitions.

        Rows are range-sorted and numbered inside partitions; the partitions' offsets are a prefix sum over their sizes, a row for each
        partition, so no task sees all rows. The numbered rows are written to the shared folder now: partitions that were
        dealt out again, or coalesced otherwise, would not fit their offsets.
        """
        df = self.df.orderBy(*order) if order else self.df
        df = stored(df.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
        sizes = df.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off"))
        out = df.join(F.broadcast(offsets), "__part")  # bounded: a row for each partition
        return Flow(out.select((F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *self.df.columns))

    # --- aggregation

    def reduce(self, how: Reducer | None = None, value: Expr | None = None, /, **named: tuple[str, Expr]) -> Flow:
        """One row: ``reduce("sum", "x")`` gives ``value``, or ``reduce(total=("sum", "x"), most=("max", "x"))``.

        ``how`` may be an associative, commutative Python function of two values, combined inside partitions first; nulls are passed over.
        """
        if callable(how):
            df = self.df.select(self._c(value).alias("v"))
            return Flow(aggregate_all(df, reducing(how), df.schema["v"].dataType.simpleString()))
        if how is not None:
            named = {"value": (how, value)} | named
        return Flow(self.df.agg(*[reduced(self._c(v), h).alias(n) for n, (h, v) in named.items()]))

    def fold(self, zero: Any, how: Reducer, value: Expr, name: str = "value") -> Flow:
        """One row: the reduction combined with ``zero``, which stands first and which an empty Flow gives alone."""
        if callable(how):
            df = self.df.select(self._c(value).alias("v"))
            return Flow(aggregate_all(df, reducing(how, lambda s: how(zero, s[0]) if s else zero), df.schema["v"].dataType.simpleString(), name))
        return Flow(self.df.agg(folded(self._c(value), how, F.lit(zero)).alias(name)))

    fold_left = fold

    def fold_right(self, zero: Any, how: Callable[[Any, Any], Any], value: Expr, name: str = "value") -> Flow:
        """The same with ``zero`` last: ``how(reduction, zero)``."""
        df = self.df.select(self._c(value).alias("v"))
        return Flow(aggregate_all(df, reducing(how, lambda s: how(s[0], zero) if s else zero), df.schema["v"].dataType.simpleString(), name))

    def aggregate(self, agg: Aggregator, value: Expr, kind: str, name: str = "value") -> Flow:
        """One row: a user's aggregator over a value, of the type ``kind``."""
        return Flow(aggregate_all(self.df.select(self._c(value).alias("v")), agg, kind, name))

    def cube(self, keys: Sequence[str], form: str = "cube", /, **named: tuple[str, Expr]) -> Flow:
        """Named reductions for all sets of the keys or, with form ``rollup``, for their prefixes (an extension)."""
        grouped = self.df.rollup(*keys) if form == "rollup" else self.df.cube(*keys)
        return Flow(grouped.agg(*[reduced(self._c(v), h).alias(n) for n, (h, v) in named.items()]))

    def count(self) -> Flow:
        """One row with one long."""
        return Flow(self.df.agg(F.count(F.lit(1)).alias("n")))

    def key_by(self, key: Expr, value: Expr | None = None) -> KeyedFlow:
        """Rows (k, v); without ``value`` v is the whole row."""
        from millrace.operators.keyed import KeyedFlow

        v = F.struct(*self.df.columns) if value is None else self._c(value)
        return KeyedFlow(self.df.select(self._c(key).alias("k"), v.alias("v")))

    def group_by(self, key: Expr, value: Expr | None = None) -> GroupedFlow:
        """Rows (k, vs): a list of the rows, or of ``value``, of each key. Lists meet in one task: reduce instead where that will do."""
        return self.key_by(key, value).group_by_key()

    def group_reduce(self, key: Expr, how: Reducer, value: Expr) -> KeyedFlow:
        """(k, reduced value); named reducers are combined on the map side."""
        return self.key_by(key, value).reduce_by_key(how)

    group_reduce_by_key = group_reduce

    def group_map_reduce(self, key: Expr, mapped: Expr, how: Reducer) -> KeyedFlow:
        """The same over a mapped value."""
        return self.key_by(key, mapped).reduce_by_key(how)

    # --- order, partitions

    def sort_by(self, *keys: Expr, ascending: bool = True) -> Flow:
        """Total order: range partitions, each sorted."""
        cols = [self._c(k) for k in keys]
        return self._of(self.df.orderBy(*cols, ascending=ascending))

    sorted = sort_by

    def sort_with(self, compare: Callable[[Row, Row], int], sample: int = 20_000) -> Flow:
        """An order that only a Python function knows; rows leave the JVM for it.

        At most ``sample`` rows, whatever the table's size, are compared on the driver to choose ranges; rows are dealt to the ranges and
        sorted there. Rows equal to several bounds are dealt over all the ranges between these. Rows are counted, sampled and dealt, so
        they are written once, to the shared folder.
        """
        from functools import cmp_to_key

        df = stored(self.df, "unsorted")
        rdd, key = df.rdd, cmp_to_key(compare)
        n = max(1, min(rdd.getNumPartitions(), sample // 20))
        share = min(1.0, 1.2 * sample / max(1, df.count()))
        picked = sorted(df.sample(False, share, 42).limit(sample).collect(), key=key)
        bounds = [picked[len(picked) * i // n] for i in range(1, n)] if picked else []

        def first(row: Row, more: int) -> int:
            """The first bound that is not below the row, or (more = 1) that is above it."""
            lo, hi = 0, len(bounds)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if compare(bounds[mid], row) < more else (lo, mid)
            return lo

        def dealt(rows: Iterator[Row]) -> Iterator[tuple[int, Row]]:
            for k, row in enumerate(rows):
                lo, hi = first(row, 0), first(row, 1)
                yield lo + k % (hi - lo + 1), row

        parts = rdd.mapPartitions(dealt).partitionBy(n, lambda i: i)
        return self._of(self.df.sparkSession.createDataFrame(parts.mapPartitions(lambda it: iter(sorted((r for _, r in it), key=cmp_to_key(compare)))), self.df.schema))

    def top(self, k: int, *keys: Expr) -> Flow:
        """The k greatest rows, greatest first; each partition gives k at most."""
        return self._of(self.df.orderBy(*[self._c(x).desc() for x in keys]).limit(k))

    def take(self, n: int) -> Flow:
        return self._of(self.df.limit(n))

    def partition_by(self, n: int, *keys: Expr) -> Flow:
        """Hash partitions; equal keys meet."""
        return self._of(self.df.repartition(n, *[self._c(k) for k in keys]))

    def partition(self, kind: str, n: int | None = None, *keys: Expr) -> Flow:
        """kind: hash, range (each partition sorted), prefix (range by the first 7 bytes of a key), round_robin, random, keep."""
        cols = [self._c(k) for k in keys]
        if kind == "hash":
            return self._of(self.df.repartition(n, *cols))
        if kind == "range":
            return self._of(self.df.repartitionByRange(n, *cols).sortWithinPartitions(*cols))
        if kind == "prefix":
            return self._of(self.df.repartitionByRange(n, *[F.substring(c.cast("binary"), 1, 7) for c in cols]).sortWithinPartitions(*cols))
        if kind in ("round_robin", "random"):
            return self._of(self.df.repartition(n))
        if kind == "keep":
            return self
        raise ValueError(f"no partitioner {kind!r}")

    def with_parallelism(self, n: int, shuffle: bool = True) -> Flow:
        """n partitions by a shuffle or, without one, n at most, put together from those there are. Nothing runs to count these."""
        return self._of(self.df.repartition(n) if shuffle else self.df.coalesce(n))

    # --- sets

    def union(self, other: Flow | DataFrame | Iterable) -> Flow:
        """All rows of both, repeats included; ``other`` may be local rows."""
        if isinstance(other, Flow):
            other = other.df
        if not isinstance(other, DataFrame):
            other = self.df.sparkSession.createDataFrame(list(other), self.df.schema)
        return self._of(self.df.union(other))

    def distinct(self, *keys: str) -> Flow:
        return self._of(self.df.dropDuplicates(list(keys)) if keys else self.df.distinct())

    def intersection(self, other: Flow, bag: bool = False) -> Flow:
        return self._of(self.df.intersectAll(other.df) if bag else self.df.intersect(other.df))

    def subtract(self, other: Flow, bag: bool = True) -> Flow:
        return self._of(self.df.exceptAll(other.df) if bag else self.df.subtract(other.df))

    # --- joins

    def join_by(self, other: Flow, key: Expr, other_key: Expr) -> KeyedFlow:
        """Inner equi-join: (k, v) with v a struct of both rows, ``left`` and ``right``. Null keys never join."""
        return self.key_by(key).join_by_key(other.key_by(other_key))

    def cogroup(self, other: Flow, key: Expr, other_key: Expr, value: Expr | None = None, other_value: Expr | None = None) -> GroupedFlow:
        """(k, left, right): the lists of both sides of each key of either side; a missing side is an empty list."""
        return self.key_by(key, value).cogroup_by_key(other.key_by(other_key, other_value))

    def zip_join(self, other: Flow, on: str | list[str], how: str = "inner") -> Flow:
        return Flow(self.df.join(other.df, on, how))

    # --- samples

    def sample_n(self, n: int) -> Flow:
        """Any n rows."""
        return self._of(self.df.limit(n))

    def sample_fraction(self, fraction: float, seed: int = 42, exact: bool = False) -> Flow:
        """Rows without replacement: each with the probability given or, exactly, floor(fraction * rows) of them (a range sort)."""
        if not exact:
            return self._of(self.df.sample(False, fraction, seed))
        mixed = Flow(self.df.withColumn("__r", F.rand(seed))).zip_with_index("__r", name="__i").df
        total = self.df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("__n"))
        return self._of(mixed.where(F.col("__i") < total.scalar()).select(*self.df.columns))

    def sample_with(self, f: Callable[[Iterator[Any]], Iterator[Any]]) -> Flow:
        """A function that picks from each partition's frames."""
        return self._of(self.df.mapInPandas(f, self.df.schema))

    # --- actions

    def cache(self) -> Flow:
        """Kept when next computed."""
        return self._of(self.df.cache())

    def cached(self) -> Flow:
        """Computed and kept now."""
        kept = self.df.cache()
        kept.count()
        return self._of(kept)

    def compute(self) -> Future:
        """Computed in the background; the future gives the kept Flow."""
        return _background.submit(self.cached)

    def traverse(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time. All of them come to the driver: walk a large table with ``map_partitions`` and traverse what that gives."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def collect(self, timeout: float | None = None) -> list[Row]:
        if timeout is None:
            return self.df.collect()
        return _background.submit(self.df.collect).result(timeout)

    def foreach(self, f: Callable[[Row], None]) -> None:
        self.df.foreach(f)

    def explain(self):
        from millrace.plans.explain import plans

        return plans(self.df)

    def trace(self):
        from millrace.plans.explain import trace

        return trace(self.df)

    def identity(self) -> Flow:
        return self
