"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all the documents that the one before has kept. All but the last return the
columns of ``documents``; texts that change carry their new ``n_chars``, and further columns, whatever their names, stay as they are.

Odd rows, stage by stage: null and empty texts fail the quality rules and go there (given to a later stage directly, line dedup and the
join keep them, the join one of each id; mixing never takes them; packing makes them one piece, id 0). A null source is a host and a source of
its own, a null id a document like others. Repeated rows pass the first two stages alike, and the join keeps one of them; of rows that tie, the
choice is by the other columns. Texts are read whole, whatever their length. An empty table gives an empty result.

A stage's intermediate tables are deleted when the next stage begins; by then its result must have been written.

Mixing puts the documents in the order of the curriculum, and packing keeps that order: its ``position`` tells the place of a piece's document, which
also tells apart the copies of a document that is taken more than once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, line_dedup, mixing, packing, quality
from millrace.tables import release, stored, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines above the limits."""
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents that had nothing else."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their positions; a document cut by its target is shorter."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its token ids, bucketed by length and within a bucket in the order of the documents."""
    return packing.pack(packing.in_order(docs), place="place")


_used: list[str] = []


def _tidy(stage: Callable) -> Callable:
    """A stage that first deletes the intermediate tables of the stage before it; those of the last one stay until the driver ends."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _used)
        before = set(written())
        out = stage(spark, docs, sf_dir)
        _used[:] = [p for p in written() if p not in before] if stage is not pack else []
        return out

    return run


STAGES = [(name, _tidy(stage)) for name, stage in (("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack))]

#: Packing encodes tokens, for which DuckDB has no function; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
