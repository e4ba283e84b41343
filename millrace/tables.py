"""Where the library finds its tables and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``; read by Spark only, so any store will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where none is set (tests, local runs) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there and lost executors cost nothing.

    The table goes when the driver ends, or when ``release`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written() -> list[str]:
    """Paths of the tables that ``stored`` has written and that are still there, in the order of writing."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes the tables at ``paths``, or all that ``stored`` has written so far; DataFrames that read them can't be used any more. How many there were."""
    gone = [p for p in _written if paths is None or p in paths]
    for path in gone:
        _written.remove(path)
        _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return len(gone)
