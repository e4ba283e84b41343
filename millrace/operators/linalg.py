"""Distributed vectors (idx, value) and matrices (row, vec: array of doubles)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.flow import Flow
from millrace.operators.reducers import Reducer, reduced

Fn = Callable[[Column], Column]


class Vector:
    """idx is unique. ``times`` and ``add`` take a missing element as 0; ``minus`` keeps only indices of both sides."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))

    @staticmethod
    def of(df: DataFrame, idx: str | Column, value: str | Column) -> Vector:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return Vector(df.select(c(idx).alias("idx"), c(value).alias("value")))

    @staticmethod
    def local(spark: SparkSession, values: Iterable[float]) -> Vector:
        return Vector(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double"))

    def _other(self, other: Vector | Iterable[float]) -> Vector:
        return other if isinstance(other, Vector) else Vector.local(self.df.sparkSession, other)

    def _both(self, other: Vector | Iterable[float], f: Callable[[Column, Column], Column], how: str) -> Vector:
        b = self._other(other).df.select("idx", F.col("value").alias("b"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return Vector(self.df.withColumnRenamed("value", "a").join(b, "idx", how).select("idx", f(zero(F.col("a")), zero(F.col("b"))).alias("value")))

    def times(self, other: Vector | Iterable[float]) -> Vector:
        return self._both(other, lambda a, b: a * b, "full")

    def add(self, other: Vector | Iterable[float] | float) -> Vector:
        return self.map_elem(lambda x: x + other) if isinstance(other, (int, float)) else self._both(other, lambda a, b: a + b, "full")

    def minus(self, other: Vector | Iterable[float] | float) -> Vector:
        return self.map_elem(lambda x: x - other) if isinstance(other, (int, float)) else self._both(other, lambda a, b: a - b, "inner")

    def multiply(self, k: float) -> Vector:
        return self.map_elem(lambda x: x * F.lit(float(k)))

    def negate(self) -> Vector:
        return self.map_elem(lambda x: -x)

    def map_elem(self, f: Fn) -> Vector:
        return Vector(self.df.select("idx", f(F.col("value")).alias("value")))

    __add__, __sub__, __neg__ = add, minus, negate

    def __mul__(self, other):
        return self.multiply(other) if isinstance(other, (int, float)) else self.times(other)

    def reduce(self, how: Reducer = "sum") -> DataFrame:
        return self.df.agg(reduced(F.col("value"), how).alias("value"))

    def sum(self) -> DataFrame:
        return self.reduce("sum")

    def size(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def inner(self, other: Vector | Iterable[float]) -> DataFrame:
        """Dot product, one row; indices of one side only add nothing, so an inner join will do."""
        return self._both(other, lambda a, b: a * b, "inner").sum()

    def concat(self, other: Vector) -> Vector:
        """``other`` after this one; its indices move up by this one's size, a scalar subquery."""
        moved = other.df.select((F.col("idx") + self.size().scalar()).alias("idx"), "value")
        return Vector(self.df.union(moved))

    def slice(self, start: int, length: int | None = None) -> Vector:
        """Indices from ``start``, itself included."""
        df = self.df.where(F.col("idx") >= start)
        return Vector(df if length is None else df.where(F.col("idx") < start + length))

    def flow(self) -> Flow:
        return Flow(self.df)


class Matrix:
    """row is unique, all vecs have the same length."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select(F.col("row").cast("long").alias("row"), F.col("vec").cast("array<double>").alias("vec"))

    @staticmethod
    def of(df: DataFrame, row: str, vec: str) -> Matrix:
        return Matrix(df.select(F.col(row).alias("row"), F.col(vec).alias("vec")))

    def map_row(self, f: Fn) -> Matrix:
        return Matrix(self.df.select("row", f(F.col("vec")).alias("vec")))

    def map_elem(self, f: Fn) -> Matrix:
        return self.map_row(lambda v: F.transform(v, f))

    def dot(self, other: list[float]) -> Vector:
        """Matrix by a local vector."""
        w = F.array(*[F.lit(float(x)) for x in other])
        return Vector.of(self.df.select("row", F.aggregate(F.zip_with("vec", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("value")), "row", "value")

    def zip_map(self, vector: Vector, f: Callable[[Column, Column], Column]) -> Matrix:
        """``f(vec, value)`` of each row and the element of a vector at the row's index."""
        return Matrix(self.df.join(vector.df.withColumnRenamed("idx", "row"), "row").select("row", f(F.col("vec"), F.col("value")).alias("vec")))

    def _cells(self) -> DataFrame:
        return self.df.select("row", F.posexplode("vec").alias("pos", "x"))

    def reduce_row(self, how: Reducer = "sum") -> Vector:
        """All rows into one, element by element: the columns' reductions. Partial sums are a row per column and task."""
        return Vector.of(self._cells().groupBy("pos").agg(reduced(F.col("x"), how).alias("value")), "pos", "value")

    def sum_row(self) -> Vector:
        return self.reduce_row("sum")

    def reduce_column(self, f: Callable[[Column, Column], Column], zero: float = 0.0) -> Vector:
        """Each row's elements into one."""
        return Vector.of(self.df.select("row", F.aggregate("vec", F.lit(float(zero)), f).alias("value")), "row", "value")

    def sum_column(self) -> Vector:
        return self.reduce_column(lambda a, x: a + x)

    def sum(self) -> DataFrame:
        return self.sum_column().sum()

    def norm(self) -> Matrix:
        """(x - mean of the column) / sqrt(sum of the column's squares), with the columns' two numbers in a scalar subquery."""
        stats = self._cells().groupBy("pos").agg(F.avg("x").alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
        line = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("st"))  # one value, as wide as a row
        scaled = F.zip_with("vec", "st", lambda x, s: F.when(s["s"] != 0, (x - s["m"]) / s["s"]).otherwise(0.0))
        return Matrix(self.df.withColumn("st", line.scalar()).select("row", scaled.alias("vec")))

    def num_rows(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def num_columns(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("long").alias("n"))

    def row(self, i: int) -> Matrix:
        return Matrix(self.df.where(F.col("row") == i))

    def column(self, j: int) -> Vector:
        return Vector.of(self.df.select("row", F.get("vec", F.lit(j)).alias("value")), "row", "value")

    def map_column(self, f: Callable[[Column, Column], Column]) -> Matrix:
        """``f(element, index of its column)`` everywhere."""
        return self.map_row(lambda v: F.transform(v, f))

    def flow(self) -> Flow:
        return Flow(self.df)
