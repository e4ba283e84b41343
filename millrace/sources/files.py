"""Sources and sinks over files; everything goes through Spark's readers, so any file system it knows will do."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.flow import Flow


def text(spark: SparkSession, path: str | list[str], whole: bool = False) -> Flow:
    """Column ``value``: a row per line (or per file)."""
    return Flow(spark.read.text(path, wholetext=whole))


def fields(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", **options) -> Flow:
    """Delimited text, typed by ``schema``; fields that don't parse are null."""
    return Flow(spark.read.schema(schema).options(sep=sep, mode="PERMISSIVE", **options).csv(path))


def split_lines(lines: Flow, pattern: str, **columns: tuple[int, str]) -> Flow:
    """Lines split by a pattern: ``split_lines(f, ",", url=(0, "string"), rank=(1, "double"))``."""
    parts = F.split("value", pattern)
    return Flow(lines.df.select(*[F.get(parts, F.lit(i)).try_cast(kind).alias(n) for n, (i, kind) in columns.items()]))


def json(spark: SparkSession, path: str | list[str], schema: str, multi_line: bool = True) -> Flow:
    """JSON objects, an array of them per file or (``multi_line=False``) one a line, which large files need to be split."""
    return Flow(spark.read.schema(schema).json(path, multiLine=multi_line))


def parquet(spark: SparkSession, *paths: str) -> Flow:
    return Flow(spark.read.parquet(*paths))


def from_url(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], Iterable] | None = None, schema: str | None = None) -> Flow:
    """Each file as bytes (path, length, content), or the rows that ``parse`` makes of its bytes."""
    df = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    if parse is None:
        return Flow(df)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                rows = list(parse(bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = StructType.fromDDL(schema).names
    return Flow(df.select("content").mapInPandas(run, schema))


def jdbc(spark: SparkSession, url: str, table: str, **options) -> Flow:
    """A table of a database whose driver is on the class path; give partitionColumn and bounds to read it in parallel."""
    return Flow(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


# --- local data


def parallelize(spark: SparkSession, rows: Sequence, schema: str, partitions: int | None = None) -> Flow:
    """Local rows; any number of partitions, also more than rows."""
    kept = list(rows)
    if kept and not isinstance(kept[0], (tuple, list, dict)):
        kept = [(x,) for x in kept]
    df = spark.createDataFrame(kept, schema)
    return Flow(df.repartition(partitions) if partitions else df)


def parallel_with_index(spark: SparkSession, rows: Sequence, schema: str, partitions: int | None = None) -> Flow:
    """The same with ``idx``, numbered before the rows are dealt out."""
    return parallelize(spark, [(i, *(r if isinstance(r, (tuple, list)) else (r,))) for i, r in enumerate(rows)], f"idx long, {schema}", partitions)


def horizontal(spark: SparkSession, schema: str, *parts: Sequence) -> Flow:
    """Local collections one after the other."""
    flows = [parallelize(spark, p, schema).df for p in parts]
    df = flows[0]
    for more in flows[1:]:
        df = df.unionByName(more)
    return Flow(df)


def vertical(*flows: Flow) -> Flow:
    """Tables side by side, row by row in their order: columns of the first, then of the next; the shortest ends it. Names must differ."""
    df = flows[0].zip_with_index(name="__at").df
    for more in flows[1:]:
        df = df.join(more.zip_with_index(name="__at").df, "__at")
    return Flow(df.drop("__at"))


# --- sinks


def write(flow: Flow | DataFrame, path: str, form: str = "parquet", mode: str = "error", by: Sequence[str] = (), **options) -> None:
    """form: parquet, json, csv, text or orc; ``compression`` among the options names the codec."""
    w = (flow.df if isinstance(flow, Flow) else flow).write.mode(mode).options(**options)
    (w.partitionBy(*by) if by else w).format(form).save(path)


def save_bucketed(flow: Flow, name: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> None:
    """A table whose joins and groupings on ``keys`` need no shuffle."""
    flow.df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
