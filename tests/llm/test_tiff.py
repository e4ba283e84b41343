import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import media, queries, tiff


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"a" * 200, b"abc", b"\0" * 700, b"xyxyz"]), max_size=40).map(b"".join)))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_long():
    data = np.random.default_rng(1).integers(0, 7, 60000, dtype=np.uint8).tobytes() + np.random.default_rng(2).bytes(20000)
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # the published example of the format: 7 7 7 8 8 7 7 6 6
    assert tiff.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80]), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, (h, w), dtype=np.uint8) for h, w in ((1, 1), (37, 50), (600, 64))]
    back = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, 32, tile, order)))
    assert [p.compression for p in back] == [compression] * 3
    assert all(np.array_equal(p.pixels, q) for p, q in zip(back, pages, strict=True))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_other_samples_round_trip(compression, tile, order):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 2, (37, 51)).astype(bool), rng.integers(0, 65536, (20, 33), dtype=np.uint16), rng.integers(0, 256, (19, 21, 3), dtype=np.uint8)]
    for planar in (1, 2):
        back = list(tiff.read_pages(tiff.write_pages(pages, compression, 2, 7, tile, order, planar)))
        assert [(p.bits, p.samples) for p in back] == [(1, 1), (16, 1), (8, 3)]
        assert all(np.array_equal(p.pixels, q.reshape(len(q), -1)) for p, q in zip(back, pages, strict=True))


def test_files_made_by_hand():
    """Bytes laid out by the format's description, not by the writer here: big-endian, one strip, PackBits; then little-endian bilevel."""
    tags = [(256, 3, 1, 4 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 32773 << 16), (262, 3, 1, 1 << 16), (273, 4, 1, 8), (278, 3, 1, 2 << 16), (279, 4, 1, 7)]
    body = bytes([0xFD, 7, 3, 1, 2, 3, 4, 0])
    data = b"MM\0*" + (16).to_bytes(4, "big") + body + len(tags).to_bytes(2, "big") + b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + n.to_bytes(4, "big") + v.to_bytes(4, "big") for t, k, n, v in tags) + b"\0" * 4
    (page,) = tiff.read_pages(data)
    assert page.pixels.tolist() == [[7, 7, 7, 7], [1, 2, 3, 4]]
    tags = [(256, 4, 1, 10), (257, 4, 1, 1), (273, 4, 1, 8), (279, 4, 1, 2)]
    data = b"II*\0" + (10).to_bytes(4, "little") + bytes([0b10100000, 0b01000000]) + len(tags).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + k.to_bytes(2, "little") + n.to_bytes(4, "little") + v.to_bytes(4, "little") for t, k, n, v in tags) + b"\0" * 4
    (page,) = tiff.read_pages(data)
    assert page.bits == 1 and page.pixels.tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 0, 1]]


def test_damaged_files_give_errors_only():
    """Every byte of small files changed, files cut anywhere, huge sizes: nothing but the errors that the table reader catches."""
    rng = np.random.default_rng(6)
    page = rng.integers(0, 4, (9, 11), dtype=np.uint8)
    for compression in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for tile in (0, 16):
            good = tiff.write_pages([page, page], compression, 2, 4, tile)
            bad = [good[:n] for n in range(0, len(good), 3)]
            for at in range(len(good)):
                for v in (0, 255, int(rng.integers(256))):
                    bad.append(good[:at] + bytes([v]) + good[at + 1 :])
            for data in bad:
                try:
                    list(tiff.read_pages(data))
                except tiff.DAMAGE as e:
                    assert not isinstance(e, MemoryError)
    with pytest.raises(ValueError):
        tiff.lzw_decode(bytes([0xFF, 0xFF, 0xFF]), 5)


def test_every_way_meets_short_and_long_texts(spark):
    ways = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        p = media.payload_of(r.text.encode())
        page = next(tiff.read_pages(media.store(p)))
        ways.setdefault((page.compression, page.predictor), []).append(len(p))
    assert len(ways) == 6 and all(min(x) < 500 < 3000 < max(x) for x in ways.values())


def test_pages_query(spark, sf_dir):
    out = queries.tiff_pages(spark, sf_dir).collect()
    texts = {r.doc_id: media.payload_of((r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in out} == set(texts) and not any(r.error for r in out)
    for r in out:
        want = texts[r.doc_id][r.page * media.WIDTH * media.PAGE_ROWS :][: media.WIDTH * media.PAGE_ROWS]
        assert r.pixels_sha256 == hashlib.sha256(want).hexdigest() and r.height * r.width == len(want)


def test_pages_of_a_table(spark):
    good = tiff.write_pages([np.arange(64, dtype=np.uint8).reshape(8, 8), np.zeros((2, 3), np.uint8)])
    rows = [(1, good), (2, b"no"), (3, None), (None, good[:-9]), (1, good)]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "id long, file binary"), "file", ["id"]).collect()
    assert sum(r.id == 1 and r.error is None for r in out) == 4 and all(r.error for r in out if r.id in (2, 3))
    assert tiff.tiff_pages(spark.createDataFrame([], "id long, file binary"), "file", ["id"]).count() == 0


def test_query(spark, sf_dir):
    out = {r.doc_id: r for r in queries.op8_tiff_media(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = r.text.encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        o = out.pop(r.doc_id)
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert not out


def test_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 400_000, "x"), (None, "a", "x"), (3, "a", "x")]
    out = media.text_to_media(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()
    assert sorted(r.payload_bytes for r in out) == [64, 64, 64, 64, 800_000]
    assert len({r.feature for r in out}) == 3
    assert media.text_to_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
