"""Loops over distributed data, and the learning steps built on them."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from millrace.tables import stored

S = TypeVar("S")


def repeat(n: int, state: S, step: Callable[[S], S]) -> S:
    for _ in range(n):
        state = step(state)
    return state


def repeat_while(state: S, go_on: Callable[[S], bool], step: Callable[[S], S], most: int | None = None) -> S:
    """``step`` for as long as ``go_on``; more than ``most`` steps, where that is given, are an error."""
    done = 0
    while go_on(state):
        if done == most:
            raise RuntimeError(f"not finished after {most} steps")
        state, done = step(state), done + 1
    return state


def tail_recursive(state: S, step: Callable[[S], tuple[bool, S]], most: int | None = None) -> S:
    """``step`` tells whether it is done, and the next state."""
    done, n = False, 0
    while not done:
        if n == most:
            raise RuntimeError(f"not finished after {most} steps")
        (done, state), n = step(state), n + 1
    return state


def repeat_table(n: int, df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table stepped n times; each state is written to the shared folder, so plans don't grow and lost executors don't matter."""
    return repeat(n, df, lambda d: stored(step(d), "state"))


def _rows(column) -> np.ndarray:
    """An Arrow column of lists of one width as a matrix; null lists are left out."""
    column = column.drop_null()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gradient(df: DataFrame, vec: str, label: str, factor: Callable[[np.ndarray, np.ndarray], np.ndarray], weights: list[float]) -> DataFrame:
    """(pos, g): sum over rows of factor(x . w, y) * x; a product of matrices for each batch, a partial vector for each task."""

    def run(batches):
        import pyarrow as pa

        w, total = np.asarray(weights, np.float64), None
        for batch in batches:
            x, y = _rows(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            if len(x):
                part = factor(x @ w, y) @ x
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["pos", "g"])

    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.mapInArrow(run, "pos int, g double").groupBy("pos").agg(F.sum("g").alias("g"))


def linear_gradient(df: DataFrame, vec: str, label: str, weights: list[float]) -> DataFrame:
    """Gradient of half the squared error, by position."""
    return _gradient(df, vec, label, lambda p, y: p - y, weights)


def logistic_gradient(df: DataFrame, vec: str, label: str, weights: list[float]) -> DataFrame:
    """Gradient of the log loss for labels -1 and 1, by position."""
    return _gradient(df, vec, label, lambda p, y: (1.0 / (1.0 + np.exp(-y * p)) - 1.0) * y, weights)


def descend(df: DataFrame, vec: str, label: str, gradient: Callable[..., DataFrame], weights: list[float], iterations: int, rate: float = 1.0, mean: bool = False) -> list[float]:
    """Gradient descent; a row per position comes back each time. ``df`` should be cached."""
    n = df.count() if mean else 1

    def step(w: list[float]) -> list[float]:
        g = {r.pos: r.g for r in gradient(df, vec, label, w).collect()}
        return [x - rate * (g.get(i) or 0.0) / max(1, n) for i, x in enumerate(w)]

    return repeat(iterations, list(weights), step)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equally near ones) and its squared distance; some rows at a time."""
    at, cost, step = [], [], max(1, (1 << 22) // max(1, centres.size))
    for i in range(0, len(x), step):
        d = ((x[i : i + step, None, :] - centres[None]) ** 2).sum(axis=2)
        at.append(d.argmin(axis=1))
        cost.append(d.min(axis=1))
    return np.concatenate(at), np.concatenate(cost)


def assigned(df: DataFrame, vec: str, centres: list[list[float]]) -> DataFrame:
    """``df`` with ``cluster``, the nearest centre (the first of equally near ones), and ``cost``, its squared distance; rows without a vector have neither."""
    names = df.columns

    def run(batches):
        import pyarrow as pa

        c = np.asarray(centres, np.float64)
        for batch in batches:
            column = batch.column(len(names))
            cluster, cost = np.zeros(len(column), np.int32), np.zeros(len(column))
            there = column.is_valid().to_numpy(zero_copy_only=False)
            if there.any():
                cluster[there], cost[there] = _nearest(_rows(column), c)
            own = [pa.array(cluster, pa.int32(), mask=~there), pa.array(cost, mask=~there)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *own], names=[*names, "cluster", "cost"])

    schema = StructType([*df.schema.fields, StructField("cluster", IntegerType()), StructField("cost", DoubleType())])
    return df.withColumn("__vec", F.col(vec).cast("array<double>")).mapInArrow(run, schema)


def kmeans_step(df: DataFrame, vec: str, centres: list[list[float]]) -> DataFrame:
    """(cluster, pos, mean, n): the next centres, of the clusters that have members; partial sums are a vector per cluster and task."""

    def run(batches):
        import pyarrow as pa

        c = np.asarray(centres, np.float64)
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            x = _rows(batch.column(0))
            if len(x):
                at, _ = _nearest(x, c)
                member = np.zeros((len(c), len(x)))
                member[at, np.arange(len(x))] = 1
                total += member @ x
                n += np.bincount(at, minlength=len(c))
        held = np.flatnonzero(n)
        width = c.shape[1]
        columns = [np.repeat(held, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(held)), total[held].ravel(), np.repeat(n[held], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cluster", "pos", "s", "n"])

    sums = df.select(F.col(vec).cast("array<double>").alias("x")).where("x IS NOT NULL").mapInArrow(run, "cluster int, pos int, s double, n long")
    return sums.groupBy("cluster", "pos").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def kmeans(df: DataFrame, vec: str, centres: list[list[float]], iterations: int) -> list[list[float]]:
    """Lloyd's steps from the centres given; a centre without members stays."""

    def step(old: list[list[float]]) -> list[list[float]]:
        new = [list(c) for c in old]
        for r in kmeans_step(df, vec, old).collect():  # centres * width rows
            new[r.cluster][r.pos] = r["mean"]
        return new

    return repeat(iterations, [list(c) for c in centres], step)
