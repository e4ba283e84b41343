import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from millrace.llm import packing, queries
from tokenizers import Tokenizer

FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [None, "", " ", "a", "<|endoftext|> x <|endoftext|>", "é" * 3000, "word " * 5000, "a" * 20000, " " * 5000, "\x00\n\r\t 😀", "x\n\n\n  y", "1234567890" * 300]


def ids(text):
    return [*FULL.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts):
    """rows: of one document each; every id lies in exactly one piece."""
    by_doc, used = collections.defaultdict(list), set()
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert r.sequence_id not in used and r.offset == 0 and r.length == 1 << r.bucket and r.length <= 1024
        used.add(r.sequence_id)
    assert set(by_doc) == set(texts) and used == set(range(len(rows)))
    for d, t in texts.items():
        want, at = np.array(ids(t), "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            if "ids" in r:
                assert r.ids == want[at : at + r.length].tolist()
            at += r.length
        assert at == len(want)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, length int")
    check(packing.pack(docs).collect(), dict(enumerate(ODD)))


@pytest.mark.parametrize("c", [" ", "\n", "\t", "a", "é"])
def test_a_million_of_one_character(c):
    text = "x" + c * 1_000_000 + "y"
    got = packing.encode(text, packing.vocabulary_path("byte_bpe_50k.tiktoken"), packing.vocabulary_path("byte_bpe_50k.json"))
    assert got.tolist() == ids(text)[:-1]


def test_order_of_documents_is_kept(spark, tmp_path):
    """Copies under one id stay apart and each bucket is in the order of the files, however these are read."""
    rows = [(i % 7, "word " * (1 + i * 37 % 50)) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / "docs"))
    docs = packing.in_order(spark.read.parquet(str(tmp_path / "docs")))
    assert [(r.doc_id, r.text) for r in docs.orderBy("place").collect()] == rows
    out = packing.pack(docs, place="place").orderBy("sequence_id").collect()
    assert [(-r.bucket, r.position, r.start) for r in out] == sorted((-r.bucket, r.position, r.start) for r in out)
    assert {(r.position, r.doc_id) for r in out} == {(i, d) for i, (d, _) in enumerate(rows)}
    local = packing.in_order(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.text) for r in local.orderBy("place").collect()] == rows


def test_query(spark, sf_dir):
    rows = queries.op7_pack_binary(spark, sf_dir).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)


def test_lengths_and_odd_tables(spark):
    for n in (1, 2, 1023, 1024, 1025, 5000):
        assert sum(packing.binary_lengths(n)) == n
    assert packing.binary_lengths(2 * 1024 + 5) == [1024, 1024, 4, 1]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert len({r.sequence_id for r in twice}) == len(twice) and sum(r.length for r in twice) == 9
