"""What a query does: its plans before it runs, its figures after."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plans:
    """The query as written, optimised and as it will run."""

    original: str
    optimised: str
    physical: str


@dataclass
class Trace:
    """One run: its figures and its plans. Stages and tasks are in Spark's event log under ``group``."""

    id: str
    app: str
    version: str
    group: str
    seconds: float
    rows: int
    stages: list[int] = field(default_factory=list)
    plans: Plans | None = None


def plans(df: DataFrame) -> Plans:
    q = df._jdf.queryExecution()
    return Plans(q.analyzed().toString(), q.optimizedPlan().toString(), q.executedPlan().toString())


def trace(df: DataFrame) -> Trace:
    """Runs ``df`` without keeping its rows and tells how it went."""
    spark = df.sparkSession
    run, seen = uuid.uuid4().hex, Observation()
    spark.sparkContext.setJobGroup(run, "millrace trace")
    began = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    took = time.time() - began
    status = spark.sparkContext.statusTracker()
    stages = sorted({s for j in status.getJobIdsForGroup(run) if (info := status.getJobInfo(j)) for s in info.stageIds})
    return Trace(run, spark.sparkContext.appName, spark.version, run, took, seen.get["rows"], stages, plans(df))


def info(df: DataFrame) -> dict:
    """A record of a query without its functions: columns, partitions, operators of the physical plan."""
    text = plans(df).physical
    return {"columns": df.dtypes, "streaming": df.isStreaming, "operators": [line.strip(" +-:*()0123456789").split("(")[0].split(" ")[0] for line in text.splitlines() if line.strip()]}
