"""Texts stored as TIFF pages and read back, with features of the pixels.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64, are the 8-bit grey pixels of an image 64 wide, in
pages of ``PAGE_ROWS`` rows. Compression (PackBits, LZW, deflate), layout (strips, tiles) and predictor (none, horizontal) are picked
by a checksum of the payload: each of the twelve ways meets texts of every length, and equal texts give equal files.

Defined results: a null text is an empty text, one row of zeros; an empty table gives an empty result; repeated rows are
stored each on its own. One text and its file are in memory at a time, beside one Arrow batch.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tiff import DEFLATE, LZW, PACKBITS, read_pages, write_pages

WIDTH = 64
PAGE_ROWS = 2048
STRIP_ROWS, TILE = 128, 32
WAYS = tuple(product((PACKBITS, LZW, DEFLATE), (0, TILE), (1, 2)))
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payload: bytes) -> bytes:
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pages = [a[i : i + PAGE_ROWS] for i in range(0, len(a), PAGE_ROWS)]
    compression, tile, predictor = WAYS[zlib.crc32(payload) % len(WAYS)]
    return write_pages(pages, compression, predictor, STRIP_ROWS, tile)


def load(media: bytes) -> tuple[bytes, int]:
    """The stored bytes and the number of pages."""
    pages = [p.pixels for p in read_pages(media)]
    return b"".join(p.tobytes() for p in pages), len(pages)


def feature(back: bytes, pages: int) -> str:
    """Pages, height, sum and distinct values of the pixels, and a hash of 64 column means (above the mean or not)."""
    a = np.frombuffer(back, np.uint8).reshape(-1, WIDTH)
    columns = a.sum(axis=0, dtype=np.int64)
    above = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    return f"{pages}:{len(a)}:{int(columns.sum())}:{np.count_nonzero(np.bincount(a.ravel(), minlength=256))}:{above}"


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH or WIDTH * (not raw))


def text_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``file``, the text as a TIFF file; for ``tiff.tiff_pages``."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store(payload_of(x.as_py())) for x in part.column(1)], pa.binary())], names=["doc_id", "file"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, file binary")


def text_to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its id and the columns of ``SCHEMA``."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for x in batch.column(1):
                raw = x.as_py()
                media = store(payload_of(raw))
                back, pages = load(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, pages)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], names=["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
