"""TIFF in and out: a reader that walks image directories, and a writer.

``read_pages`` follows the chain of image directories (either byte order), gathers strips or tiles (chunky or planar), decodes them
(none, PackBits, LZW, deflate), undoes the horizontal predictor and returns a row per page: bilevel, 8-bit or 16-bit samples.
``write_pages`` makes strips or tiles in any of these compressions. ``tiff_pages`` maps the reader over a DataFrame with a binary column.

Defined results: a null or damaged file gives the pages before the damage and its error in ``error`` (one row with page null); sizes
in a header are checked against the file before memory is taken; an empty table gives an
empty result; an image of a file is held in memory once, decoded; repeated rows are decoded each on its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTO, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x (width * samples), uint8 or uint16
    bits: int = 8


# --- codecs


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts, out, held = np.concatenate([[0], edges]), bytearray(), 0
    ends = np.concatenate([edges, [len(a)]])

    def literal(upto: int) -> None:
        nonlocal held
        while held < upto:
            n = min(128, upto - held)
            out.append(n - 1)
            out.extend(data[held : held + n])
            held += n

    for s, e in zip(starts[ends - starts >= 3].tolist(), ends[ends - starts >= 3].tolist(), strict=True):
        literal(s)
        while held < e:
            n = min(128, e - held)
            out += bytes(((257 - n) & 255 if n > 1 else 0, data[s]))
            held += n
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widened one entry early."""
    table, after, codes, seen = {}, 258, [256], -1
    for b in data:
        k = seen << 8 | b
        if seen < 0:
            seen = b
        elif (c := table.get(k)) is not None:
            seen = c
        else:
            codes.append(seen)
            table[k], seen = after, b
            after += 1
            if after > 4093:
                codes.append(256)
                table, after = {}, 258
    codes += [seen, 257] if seen >= 0 else [257]
    a, at = np.array(codes, np.uint32), np.arange(len(codes))
    reset = np.maximum.accumulate(np.where(a == 256, at, 0))
    entries = 257 + at - np.concatenate([[0], reset[:-1]])  # in the table when a code is written
    width = 9 + sum((entries >= 1 << k).astype(np.int64) for k in (9, 10, 11))
    bits = (a[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, acc, bits, out, last = first[:], 9, 0, 0, [], None
    n = 0
    for b in data:
        acc, bits = acc << 8 | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257 or n >= size:
            break
        if code == 256:
            table, width, last = first[:], 9, None
            continue
        if last is None:
            if code > 255:
                raise ValueError("LZW code out of range")
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + word[:1])
        out.append(word)
        n += len(word)
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


_ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}


#: how many bytes a byte of each compression can stand for at most
_MOST = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if size > _MOST.get(compression, 1) * len(data):
        raise ValueError("short strip or tile")
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError("short strip or tile")
    return out[:size]


# --- reader


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if form := _FORMS.get(kind):
            need = struct.calcsize(form) * count
            where = at + 10 + 12 * i
            if need > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + need > len(data):
                raise ValueError("a tag lies outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    walked = set()
    while at:
        if at in walked:
            raise ValueError("directories form a loop")
        walked.add(at)
        tags, at = _directory(data, at, order)
        one = lambda t, default=None: tags[t][0] if tags.get(t) else default  # noqa: B023, E731
        width, height, samples, planar = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1), one(_PLANAR, 1)
        compression, predictor, bits = one(_COMPRESSION, NONE), one(_PREDICTOR, 1), one(_BITS, 1)
        if min(width, height, samples) < 1 or any(b != bits for b in tags.get(_BITS, (1,))) or bits not in (1, 8, 16) or planar not in (1, 2):
            raise ValueError("sizes or samples that are not read")
        tiled = _TILE_OFFSETS in tags
        if tiled:
            bw, bh = one(_TILE_W, 0), one(_TILE_H, 0)
            parts = list(zip(tags[_TILE_OFFSETS], tags[_TILE_COUNTS], strict=True))
        else:
            bw, bh = width, min(one(_ROWS, height), height)
            parts = list(zip(tags[_OFFSETS], tags[_COUNTS], strict=True))
        if min(bw, bh) < 1:
            raise ValueError("empty strips or tiles")
        across, down = -(-width // bw), -(-height // bh)
        planes, deep = (samples, 1) if planar == 2 else (1, samples)  # planar: a plane's parts after the other's
        if len(parts) != across * down * planes:
            raise ValueError("strips or tiles are missing")
        # before any memory is taken: the parts must be able to hold the page
        if width * height * samples * bits > 8 * _MOST.get(compression, 1) * sum(min(n, max(0, len(data) - start)) for start, n in parts):
            raise ValueError("the page is larger than its data")
        kind = np.dtype(order + "u2") if bits == 16 else np.dtype(np.uint8)
        out = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k, (start, n) in enumerate(parts):
            plane, at_part = divmod(k, across * down)
            top, left = at_part // across * bh, at_part % across * bw
            rows = bh if tiled else min(bh, height - top)
            line = -(-bw * deep * bits // 8)
            raw = _decode(data[start : start + n], compression, rows * line)
            if bits == 1:
                block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : bw * deep].reshape(rows, bw, deep)
            else:
                block = np.frombuffer(raw, kind).reshape(rows, bw, deep)
            if predictor == 2 and bits > 1:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            elif predictor != 1:
                raise ValueError(f"predictor {predictor}")
            r, c = min(rows, height - top), min(bw, width - left)
            out[top : top + r, left : left + c, plane : plane + deep] = block[:r, :c]
        yield Page(width, height, samples, compression, predictor, out.reshape(height, width * samples), bits)


# --- writer


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: int = 0, order: str = "<", planar: int = 1) -> bytes:
    """Pages (height x width, or x samples; uint8, uint16 or bool) as a TIFF file; strips of ``rows`` rows, or square tiles of ``tile``.

    Bilevel pages (bool) are written without a predictor. planar 2: each sample has strips or tiles of its own.
    """
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        bits, own = {"b": (1, 1), "u": (8 * page.dtype.itemsize, predictor)}[page.dtype.kind]
        bw, bh = (tile, tile) if tile else (width, min(rows, height))
        at, counts = [], []
        for plane in [page[:, :, i : i + 1] for i in range(samples)] if planar == 2 else [page]:
            for top in range(0, height, bh):
                for left in range(0, width, bw):
                    block = plane[top : top + bh, left : left + bw]
                    if tile:
                        block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                    if own == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                    flat = block.reshape(len(block), -1)
                    raw = np.packbits(flat, axis=1) if bits == 1 else flat.astype(flat.dtype.newbyteorder(order))
                    coded = _ENCODE[compression](np.ascontiguousarray(raw).tobytes())
                    at.append(len(out))
                    counts.append(len(coded))
                    out += coded + b"\0" * (len(coded) & 1)
        where = [(_TILE_W, bw), (_TILE_H, bh), (_TILE_OFFSETS, at), (_TILE_COUNTS, counts)] if tile else [(_OFFSETS, at), (_ROWS, bh), (_COUNTS, counts)]
        tags = sorted([(_WIDTH, width), (_HEIGHT, height), (_BITS, [bits] * samples), (_COMPRESSION, compression), (_PHOTO, 1), (_SAMPLES, samples), (_PLANAR, planar), (_PREDICTOR, own), *where], key=lambda x: x[0])
        entries = b""
        for tag, v in tags:
            vs = v if isinstance(v, list) else [v]
            if len(vs) > 1:
                entries += struct.pack(order + "HHII", tag, 4, len(vs), len(out))
                out += struct.pack(f"{order}{len(vs)}I", *vs)
            else:
                entries += struct.pack(order + "HHII", tag, 4, 1, vs[0])
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- over DataFrames

#: what the reader meets in damaged files
DAMAGE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)
PAGES = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row per page of each file in ``column``, with the ``keys`` of its row."""
    schema = df.select(*keys).schema.simpleString()[7:-1] + "," + PAGES if keys else PAGES

    def pages(batches):
        import pyarrow as pa

        for batch in batches:
            files = batch.column(len(keys))
            for i in range(batch.num_rows):
                rows = []
                try:
                    for n, p in enumerate(read_pages(files[i].as_py() or b"")):
                        rows.append((n, p.width, p.height, p.samples, p.compression, p.predictor, p.pixels.tobytes(), None))
                except DAMAGE as e:
                    rows.append((None,) * 7 + (str(e),))
                own = [pa.concat_arrays([batch.column(k).slice(i, 1)] * len(rows)) for k in range(len(keys))]
                kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays(own + [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[*keys, *[x.split()[0] for x in PAGES.split(", ")]])

    return df.select(*keys, column).mapInArrow(pages, schema)
