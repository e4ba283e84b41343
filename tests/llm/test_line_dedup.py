import collections
import hashlib
import random
import re

import __spark_entry__
from millrace.llm import line_dedup, queries
from pyspark.sql import functions as F
from tests.oracle import compare

PRIME, W = 2_147_483_647, r"[^\x20\x09-\x0D]+"


def n_words(x):
    return len(re.findall(W, x))


def cut(ls):
    """(first, size) of all chunks of two lines or more."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % PRIME for x in ls]
    out, first = [], 0
    zero = lambda i: i >= 1 and (h[i] + h[i - 1] * 3) % PRIME % 3 == 0
    for i in range(len(ls)):
        if zero(i) and not zero(i - 1) or i == len(ls) - 1:
            if i > first:
                out.append((first, i - first + 1))
            first = i + 1
    return out


def brute(docs):
    """docs: id -> text; id -> text without repeated chunks and stretches, the first occurrence by id kept."""
    where, out = collections.defaultdict(list), {}
    filled = {d: [x for x in (t or "").split("\n") if n_words(x)] for d, t in docs.items()}
    for d, ls in filled.items():
        for first, size in cut(ls):
            where[1, "\n".join(ls[first : first + size])].append((d, first, size))
        for i in range(len(ls) - 1):
            where[2, "\n".join(ls[i : i + 2])].append((d, i, 2))
        for i, x in enumerate(ls):
            if n_words(x) >= 50:
                where[3, x].append((d, i, 1))
    gone, starts = collections.defaultdict(set), collections.defaultdict(list)
    for (kind, _), places in where.items():
        for d, first, size in sorted(places)[1:]:
            if kind == 2:
                starts[d].append(first)
            else:
                gone[d].update(range(first, first + size))
    for d, s in starts.items():
        s = sorted(s)
        while s:
            n = 1
            while n < len(s) and s[n] == s[n - 1] + 1:
                n += 1
            a, z, s = s[0], s[n - 1] + 1, s[n:]
            if sum(map(n_words, filled[d][a : z + 1])) >= 50:
                gone[d].update(range(a, z + 1))
    for d, t in docs.items():
        p, kept = -1, []
        for x in (t or "").split("\n"):
            p += n_words(x) > 0
            if p not in gone[d]:
                kept.append(x)
        out[d] = "\n".join(kept) if gone[d] else t
    return out


def left(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.id: r.left for r in line_dedup.mark(df).selectExpr("row.doc_id id", "left").collect()}


def test_matches_brute_force(spark, sf_dir):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 8, 60]))) for _ in range(40)] + [""]
    docs = {i: "\n".join(rng.choices(pool, k=rng.randrange(1, 30))) for i in range(120)} | {200: None, 201: "", 202: "\n\n\n", 203: "\n" * 5000, 204: "w " * 30000}
    assert left(spark, docs) == brute(docs)
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert left(spark, real) == brute(real)


def test_shifted_passages_are_found(spark):
    """A passage of 40 lines under other lines goes entirely; long lines by themselves."""
    lines = lambda k, n: [f"{k} line {i} of its own text" for i in range(n)]
    docs = {}
    for p in range(25):
        passage = lines(f"shared{p}", 40)
        docs[2 * p] = "\n".join(lines(f"a{p}", 7) + passage + lines(f"b{p}", 5))
        docs[2 * p + 1] = "\n".join(lines(f"c{p}", p % 5) + passage + lines(f"d{p}", 9))
    docs |= {103: "\n".join(["x y"] + ["long " * 60] + ["z"]), 104: "\n".join(["q"] + ["long " * 60])}
    got = left(spark, docs)
    assert all(got[2 * p] == docs[2 * p] for p in range(25)) and got[103] == docs[103] and got[104] == "q"
    assert not any(x.startswith("shared") for p in range(25) for x in got[2 * p + 1].split("\n"))
    assert all(x in got[2 * p + 1] for p in range(25) for x in lines(f"c{p}", p % 5) + lines(f"d{p}", 9))


def test_short_passages_of_over_fifty_words_go_entirely(spark):
    """Passages of a few lines that repeat once between other lines; below fifty words only chunks go."""
    docs, d = {}, 0
    say = lambda tag, n: " ".join(f"{tag}w{i}" for i in range(n))
    for n, words in ((2, 26), (2, 40), (3, 20), (3, 45), (4, 13), (4, 40), (6, 9), (10, 6), (10, 40)):
        for rep in range(6):
            passage = [say(f"p{n}x{words}x{rep}x{i}", words) for i in range(n)]
            for _ in range(2):
                docs[d] = "\n".join([say(f"a{d}x{i}", 9) for i in range(rep)] + passage + [say(f"b{d}x{i}", 9) for i in range(3)])
                d += 1
    got = left(spark, docs)
    for i in range(0, d, 2):
        assert got[i] == docs[i]
        assert got[i + 1] == "\n".join(x for x in docs[i + 1].split("\n") if x[0] != "p"), i


def test_every_line_removed_stays_somewhere(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(12)]
    docs = {i: "\n".join(rng.choices(pool, k=rng.randrange(1, 25))) for i in range(60)}
    before, after = ({x for t in v.values() for x in t.split("\n")} for v in (docs, left(spark, docs)))
    assert before <= after | {""}


def test_lines_of_one_hash_and_unlike_texts_stay(spark, monkeypatch):
    """With a hash that takes all lines for one, bytes decide: nothing is lost."""
    monkeypatch.setattr(line_dedup, "line_hash", lambda x: F.length(x).cast("long"))
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *cs, f=F.xxhash64: F.length(cs[0]).cast("long") if len(cs) == 1 and "lambda" in str(cs[0]) else f(*cs))
    words = lambda tag: " ".join(f"{tag}{i:02d}" for i in range(30))
    docs = {i: "\n".join(words(c) for c in x) for i, x in enumerate(["ab", "cd", "ab"])}
    got = left(spark, docs)
    assert got[0] == docs[0] and got[1] == docs[1]


def test_dedup_keeps_columns(spark):
    text = "\n".join(f"line {i} and more" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, "a"), (1, text, 1, "a"), (2, text, 2, "b"), (None, text, 3, "c"), (5, None, 0, "d")], "doc_id long, text string, n_chars long, left string")
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(r.doc_id == 1 and r.text == text for r in rows) == 2 and {r.left for r in rows} >= {"a", "d"}
    assert all(len(r.text) == r.n_chars for r in rows if r.doc_id == 2)
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    out = {r.doc_id: r.chars_left for r in queries.op3_line_dedup(spark, sf_dir).collect()}
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert out == {d: len(t) for d, t in brute(real).items()}


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op3_line_dedup", sf_dir) > 0
