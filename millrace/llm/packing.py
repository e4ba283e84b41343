"""Packing by powers of two: each document is cut into pieces of binary lengths, and pieces of equal length are put together.

A document's tokens (its ids, then id 0) are cut from the start into as many pieces of ``MAX_LEN`` as fit and then by the binary
digits of the rest, the largest first. Every piece is a sequence of its own whose length is a power of two: no sequence
crosses documents and none is padded. Sequences of 2 ** ``bucket`` tokens form a bucket; the output is range-sorted by (bucket,
place of the document, start), so a batch of one length is a run of rows, and ``sequence_id`` numbers the rows from 0 without gaps.
The place of a document is its id or, for a table that a curriculum has put in order (``in_order``), its place in that order.

Ids come from the byte-level BPE file ``byte_bpe_50k``: its rank form by tiktoken, which gives the same ids several times
faster (tested), except for texts that hold a special token's string, and those that it gives up on (long runs of one
character): the tokenizers library encodes them.

Defined results: null text is empty text: one piece, id 0; an empty table gives an empty result; repeated rows are packed each
on its own; other columns, also those named like the result's, are ignored. A text is in memory with its tokens, beside one Arrow batch.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.flow import Flow
from millrace.tables import stored

MAX_LEN = 1024
SPECIAL = "<|endoftext|>"
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _full(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, ranks_path: str, json_path: str) -> np.ndarray:
    if SPECIAL not in text:
        try:
            return _fast(ranks_path).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its regular expression has a limited stack
            pass
    return np.array(_full(json_path).encode(text, add_special_tokens=False).ids, "<u4")


def binary_lengths(n: int, most: int = MAX_LEN) -> list[int]:
    """``most`` as often as it fits, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``, a long that grows with the order of the rows.

    Where ``docs`` reads Spark's Parquet files this is the order of files and rows in them, whatever way the files are dealt to tasks,
    and numbers the rows from 0; a row per file is counted and broadcast. Else it is the order of the partitions.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != "place"]
    number = lambda pattern: F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    file = F.struct(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("more"))  # a task may write several files
    try:
        df = docs.select(*names, file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.select(*names, F.monotonically_increasing_id().alias("place"))
    sizes = docs.select(file.alias("__file"), F.col("_metadata.row_index").alias("__row")).groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    offsets = sizes.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__off"))
    return df.join(F.broadcast(offsets), "__file").select(*names, (F.col("__off") + F.col("__row")).alias("place"))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, ranks_path: str | None = None, json_path: str | None = None, place: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, ``place`` (that column, or null) and, with ``with_ids``, its ids (array of int)."""
    ranks_path, json_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken"), json_path or vocabulary_path("byte_bpe_50k.json")
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(place) if place else F.lit(None).cast("int")).alias("place"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index, start, length, crc, whole, ids = [], [], [], [], [], []
                for i, x in enumerate(part.column(1)):
                    a = np.append(encode(x.as_py(), ranks_path, json_path), np.uint32(0)).astype("<u4", copy=False)
                    s = 0
                    for n in binary_lengths(len(a)):
                        index.append(i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(a[s : s + n].tobytes()))
                        s += n
                    whole += [len(a)] * (len(start) - len(whole))
                    ids.append(a)
                of = pa.array(index, pa.int32())
                columns = [part.column(0).take(of), *[pa.array(c, pa.int64()) for c in (start, length, crc, whole)], part.column(2).take(of)]
                names = ["doc_id", *[c.split()[0] for c in PIECE.split(", ")], "place"]
                if with_ids:
                    flat = pa.array(np.concatenate(ids).astype("i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype("i4")), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind('doc_id')}, {PIECE}, place {kind('place')}" + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, place: str | None = None) -> DataFrame:
    """The pieces bucketed by length, with ``bucket``, ``sequence_id`` and ``offset`` (always 0: a piece is a sequence).

    With ``place`` (a column of ``docs`` that orders them) each bucket is in that order, and the column stays, as ``position``.
    """
    # a range sort reads its input twice, to sample it and to deal it out: written once, texts are encoded once
    df = stored(pieces(docs, doc_id, text, with_ids, place=place), "pieces").withColumn("bucket", F.log2("length").cast("int"))
    order = [F.col("bucket").desc(), "place", F.col("doc_id").asc_nulls_last(), "start", "ids_crc32"]
    out = Flow(df).zip_with_index(*order, name="sequence_id").df.withColumn("offset", F.lit(0).cast("long"))
    return out.withColumnRenamed("place", "position") if place else out.drop("place")
