"""Pipelines of steps: a source, transformations, a sink."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.explain import Trace, trace


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """``source`` makes a DataFrame, steps transform it, ``sink`` takes the result; nothing runs before ``run`` does."""

    name: str
    version: str
    source: Callable[[SparkSession], DataFrame]
    steps: list[Step] = field(default_factory=list)
    sink: Callable[[DataFrame], None] | None = None

    def then(self, name: str, run: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(self.name, self.version, self.source, [*self.steps, Step(name, run)], self.sink)

    def into(self, sink: Callable[[DataFrame], None]) -> Pipeline:
        return Pipeline(self.name, self.version, self.source, self.steps, sink)

    def frame(self, spark: SparkSession) -> DataFrame:
        df = self.source(spark)
        for s in self.steps:
            df = df.transform(s.run)
        return df

    def run(self, spark: SparkSession) -> DataFrame:
        df = self.frame(spark)
        if self.sink:
            self.sink(df)
        return df

    def trace(self, spark: SparkSession) -> Trace:
        return trace(self.frame(spark))


def _version(v: str) -> list[tuple]:
    """Numbers by their value, and after other parts: 9 before 10, 2.0-rc1 before 2.0.1."""
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.findall(r"\d+|[^\d.]+", v)]


class Registry:
    """Pipelines by name and version; the newest version is the default."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], Pipeline] = {}

    def submit(self, p: Pipeline) -> None:
        self._held[p.name, p.version] = p

    def get(self, name: str, version: str | None = None) -> Pipeline:
        versions = self.versions(name)
        if not versions:
            raise KeyError(name)
        return self._held[name, version or versions[-1]]

    def versions(self, name: str) -> list[str]:
        """Oldest first."""
        return sorted((v for n, v in self._held if n == name), key=_version)
