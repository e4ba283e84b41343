import hashlib
import re

import __spark_entry__
from millrace.llm import pii, queries
from tests.oracle import compare

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if ok(m[0])]
    return out


CASES = [
    None, "", "a@b.c_d@e.f and x.y+z@q-r.co.uk..", "@a.b a@b a@.c", "1.2.3.4.5.6.7.8 300.1.1.1 007.08.09.255",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111222", "+1 (017) 555-7713 +49 1 +1234567890123456", "9" * 20001, "x" * 5000 + "@" + "y" * 5000 + ".z",
    "Żółć 😀 mail: zoe@ex.org 😀 10.0.0.1", "GB82 WEST 1234 5698 7654 32 my iban", "GB82WEST12345698765431", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "4111111111111111 " * 3, "\x01\x02 a@b.cc \x01",
]


def test_base_matches_brute_force(spark, sf_dir):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == brute(t), (i, t and t[:80])


def test_own_kinds_and_score(spark):
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")).collect()
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert "iban" in kinds[10] and "iban" not in kinds[11] and kinds[12] == ["secret"]
    assert all(0 <= s.score <= 1 for r in rows for s in r.spans)
    near = pii.find_pii(spark.createDataFrame([(1, "call +1 (017) 555-7713"), (2, "sample +1 (017) 555-7713")], "doc_id long, text string")).collect()
    assert near[0].spans[0].score > near[1].spans[0].score
    iban = "GB82 WEST 1234 5698 7654 32"
    texts = [f"our bank {iban}", f"an example: {iban}", f"an example account {iban}", iban, f"{iban} " + "x" * 60 + " example"]
    got = {r.doc_id: len(r.spans) for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 1, 4: 1}


def test_many_matches_in_one_text(spark):
    """Positions stay right, and the time grows with the matches, not with their square."""
    import time

    took = []
    for n in (2_000, 40_000):
        text = " é ".join(f"a{i}@b.cc 10.0.{i % 300}.1" for i in range(n))
        began = time.time()
        (r,) = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        took.append(time.time() - began)
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE] == brute(text)
    assert took[1] < 60


def test_query_and_odd_tables(spark, sf_dir, tmp_path):
    out = queries.op10_pii(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.base_sha256 for r in out} == {i: hashlib.sha256(",".join(brute(t)).encode()).hexdigest() for i, t in texts.items()}
    empty = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert pii.find_pii(empty).count() == 0
    assert pii.find_pii(spark.createDataFrame([(1, None, 3), (None, "a@b.c", 4), (1, None, 3)], "doc_id long, text string, spans int")).count() == 3


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op10_pii", sf_dir) > 0
    assert compare(spark, __spark_entry__, "op10_pii", "/root/testdata/sf0.01") > 0
