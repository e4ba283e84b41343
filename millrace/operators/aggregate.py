"""Reductions by opaque functions, combined inside partitions before anything is shuffled.

A function or an ``Aggregator`` runs on Arrow batches: every task folds its rows to one state a key, states are dealt by key, and the states of a key
are merged as they come, one in memory at a time. So a hot key sends a row from each task (or from each ``MAX_KEYS`` distinct keys of it), and no list of a
key's values is ever made. Functions must be associative and commutative, as the order of rows isn't defined.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: keys whose states a task holds before it passes them on
MAX_KEYS = 100_000


@dataclass(frozen=True)
class Aggregator:
    """``zero()`` begins a state, ``step(state, value)`` takes in a value (null is None), ``merge(a, b)`` joins two states, ``result(state)`` ends it."""

    zero: Callable[[], Any]
    step: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any] = lambda state: state


def reducing(f: Callable[[Any, Any], Any], finish: Callable[[tuple], Any] = lambda state: state[0] if state else None) -> Aggregator:
    """A function of two values as an aggregator; nulls are passed over, and no values give null. A state is () or (value,)."""
    join = lambda a, b: (f(a[0], b[0]),) if a and b else a or b
    return Aggregator(tuple, lambda s, v: s if v is None else join(s, (v,)), join, finish)


def _hashable(k: Any) -> Any:
    if isinstance(k, dict):
        return tuple((n, _hashable(x)) for n, x in k.items())
    if isinstance(k, list):
        return tuple(map(_hashable, k))
    return "nan" if k != k else k


def _states(agg: Aggregator) -> Callable[[Iterator], Iterator]:
    """Batches of (k, v) -> batches of (k, state), a row for each key a task has met."""

    def run(batches):
        import pyarrow as pa

        held: dict[Any, list] = {}

        def passed_on(kind):
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([pickle.dumps(s) for _, s in rows], pa.binary())], names=["k", "state"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = held.get(h := _hashable(k))
                if at is None:
                    at = held[h] = [k, agg.zero()]
                at[1] = agg.step(at[1], v)
            if len(held) > MAX_KEYS:
                yield passed_on(kind)
        if held:
            yield passed_on(kind)

    return run


def _merged(agg: Aggregator, kind, last: bool, always: bool = False) -> Callable[[Iterator], Iterator]:
    """Batches of (k, state), sorted by k -> a row per key: its state or, at last, its result. always: a result also for no rows."""

    def run(batches):
        import pyarrow as pa

        def out(rows, key_type):
            ends = pa.array([agg.result(s) for _, s in rows], kind) if last else pa.array([pickle.dumps(s) for _, s in rows], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], key_type), ends], names=["k", "v" if last else "state"])

        now, rows, key_type = None, [], pa.int32()
        for batch in batches:
            key_type = batch.column(0).type
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state = pickle.loads(s.as_py())
                if now is not None and _hashable(now[0]) == _hashable(k):
                    now = (k, agg.merge(now[1], state))
                    continue
                if now is not None:
                    rows.append(now)
                now = (k, state)
            if len(rows) >= 4096:
                yield out(rows, key_type)
                rows = []
        if now is not None or always:
            rows.append(now or (0, agg.zero()))
        if rows:
            yield out(rows, key_type)

    return run


def aggregate_by_key(df: DataFrame, agg: Aggregator, kind: str) -> DataFrame:
    """df: (k, v); (k, v) with v the aggregate of a key's values, of the type ``kind``. Null is a key."""
    from pyspark.sql.pandas.types import to_arrow_type

    result = StructType.fromDDL(f"v {kind}")["v"].dataType
    key = df.schema["k"].dataType
    from pyspark.sql.types import BinaryType

    states = df.select("k", "v").mapInArrow(_states(agg), StructType([StructField("k", key), StructField("state", BinaryType())]))
    return states.repartition("k").sortWithinPartitions("k").mapInArrow(_merged(agg, to_arrow_type(result), True), StructType([StructField("k", key), StructField("v", result)]))


def aggregate_all(df: DataFrame, agg: Aggregator, kind: str, name: str = "value") -> DataFrame:
    """df: (v); one row. The tasks' states meet in a few tasks first, then in one."""
    from pyspark.sql.pandas.types import to_arrow_type

    result = StructType.fromDDL(f"v {kind}")["v"].dataType
    states = df.select(F.lit(0).alias("k"), "v").mapInArrow(_states(agg), "k int, state binary")
    few = states.repartition(32).mapInArrow(_merged(agg, None, False), "k int, state binary")
    return few.coalesce(1).mapInArrow(_merged(agg, to_arrow_type(result), True, True), StructType([StructField("k", few.schema["k"].dataType), StructField("v", result)])).select(F.col("v").alias(name))


# --- divide and conquer over the rows of a table


def divide_and_conquer(df: DataFrame, solve: Callable[[list], Any], join: Callable[[Any, Any], Any], kind: str, name: str = "value") -> DataFrame:
    """One row: each task's batches of the only column of ``df`` are solved by themselves, and solutions joined pairwise up to one.

    The skeletons that map, split and merge are cases of it: map and reduce, split by partitions and merge.
    """
    column = df.columns[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((solve(batch.column(0).to_pylist()),))], pa.binary())], names=["v"])

    parts = df.select(column).mapInArrow(run, "v binary")
    whole = reducing(join)
    return aggregate_all(parts, Aggregator(tuple, lambda s, v: whole.merge(s, pickle.loads(v)), whole.merge, whole.result), kind, name)
