"""HTTP as a source of lines and a sink of rows, by Spark's Python data source interface."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from millrace.operators.flow import Flow

TIMEOUT_S = 60


def get(url: str) -> bytes:
    """The body; any status but 200 is an error."""
    with urlopen(Request(url), timeout=TIMEOUT_S) as r:
        if r.status != 200:
            raise RuntimeError(f"{url}: status {r.status}")
        return r.read()


def post(url: str, body: bytes, kind: str = "application/octet-stream") -> bytes:
    with urlopen(Request(url, data=body, headers={"Content-Type": kind}, method="POST"), timeout=TIMEOUT_S) as r:
        if r.status != 200:
            raise RuntimeError(f"{url}: status {r.status}")
        return r.read()


class _Url(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        with urlopen(Request(partition.url), timeout=TIMEOUT_S) as r:
            for line in r:
                yield partition.url, line.decode("utf-8", "replace").rstrip("\r\n")


class _Writer(DataSourceWriter):
    def __init__(self, url: str, batch: int) -> None:
        self.url, self.batch = url, batch

    def write(self, rows: Iterator) -> WriterCommitMessage:
        held = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == self.batch:
                post(self.url, json.dumps(held).encode(), "application/json")
                held = []
        if held:
            post(self.url, json.dumps(held).encode(), "application/json")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class HttpSource(DataSource):
    """Options: ``urls`` (blank-separated) to read; ``url`` and ``batch`` to write."""

    @classmethod
    def name(cls) -> str:
        return "millrace_http"

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["urls"].split())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["url"], int(self.options.get("batch", "1000")))


def http_lines(spark: SparkSession, *urls: str) -> Flow:
    """(url, value): a row per line; each URL is read by a task of its own."""
    spark.dataSource.register(HttpSource)
    return Flow(spark.read.format("millrace_http").option("urls", " ".join(urls)).load())


def http_post(df: DataFrame, url: str, batch: int = 1000) -> None:
    """Rows as JSON arrays of up to ``batch`` objects; a task that is run again posts again."""
    df.sparkSession.dataSource.register(HttpSource)
    df.write.format("millrace_http").mode("append").option("url", url).option("batch", str(batch)).save()
