import random
import re

import __spark_entry__
import numpy as np
import pytest
from millrace.llm import jaccard_join as jj
from millrace.llm import queries
from tests.oracle import compare


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(docs, percent=85):
    """docs: id -> text; id -> (n_shingles, component_id)."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids, by_shingle = sorted(docs), {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in docs}


def found(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(df).collect()}


def corpus(seed, n=150):
    """Chains of edits of a few documents, a passage in many, short texts, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(25)]
    docs, bases = {}, [[word() for _ in range(rng.choice([3, 6, 40, 160, 400]))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(w) // 40)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w[0:0] = passage
        docs[i * 7 % 1000] = rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in w)
    return docs | {2000: None, 2001: "", 2002: " \n", 2003: "É x", 2004: "é X", 2005: "one two", 2006: "ONE two", 2007: "one  two three four"}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == brute(docs)


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    """Blocks within cells, pivots beside them, and what is left over in blocks of its own."""
    monkeypatch.setattr(jj, "BLOCK", 6)
    monkeypatch.setattr(jj, "REST", 9)
    monkeypatch.setattr(jj, "PIVOTS", 1)
    for seed in (3, 5):
        docs = corpus(seed, 120)
        # unlike documents that share nearly all their shingles' rare ends: a cell without a large component
        rng = random.Random(seed)
        base = [f"c{i}" for i in range(60)]
        for i in range(60):
            w = list(base)
            for _ in range(rng.choice([1, 2, 5, 6])):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            docs[3000 + i] = " ".join(w)
        assert found(spark, docs) == brute(docs)


def sent(spark, monkeypatch, rows):
    """How many texts the joins of cells get."""
    counts, real = [], jj._cell_links
    monkeypatch.setattr(jj, "_cell_links", lambda df, percent: (counts.append(df.count()), real(df, percent))[1])
    jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count()
    return sum(counts)


def test_null_and_repeated_ids_cost_what_others_cost(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(w), " ".join(w[:-1])]
    plain = sent(spark, monkeypatch, list(enumerate(texts)))
    assert 400 <= plain <= 2000
    assert sent(spark, monkeypatch, [(None, t) for t in texts]) <= 1.2 * plain
    assert sent(spark, monkeypatch, [(7, t) for t in texts]) <= 1.2 * plain
    assert sent(spark, monkeypatch, [(7, t) for t in texts] * 5) <= 1.2 * plain


def test_near_copies_send_rows_in_proportion(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    near = lambda n: [(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]])) for i in range(n)]
    small, large = sent(spark, monkeypatch, near(800)), sent(spark, monkeypatch, near(3200))
    assert large < 5 * small


def test_other_thresholds(spark):
    docs = corpus(6, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for percent in (70, 95):
        assert {r.doc_id: r.component_id for r in jj.jaccard_components(df, percent=percent).collect()} == {d: c for d, (_, c) in brute(docs, percent).items()}


def test_forest_of_one_key():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(230, 300)], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(300)]
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(300):
        for j in range(i):
            s = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * s >= 85 * (len(sets[i]) + len(sets[j]) - s) and root(i) != root(j):
                parent[root(i)] = root(j)
    for side in (None,):
        out = jj.links(list(range(300)), sets, side)
    got = list(range(300))

    def groot(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in out:
        assert groot(a) != groot(b)
        got[groot(a)] = groot(b)
    same = lambda r: {frozenset(i for i in range(300) if r(i) == r(k)) for k in range(300)}
    assert same(groot) == same(root)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 7)]
    got = {r.v: r.root for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {5: 3, 9: 3}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, sf_dir).collect()} == brute(texts)


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op6_ngram_jaccard", sf_dir) > 0


def test_odd_tables(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (None, "x", 4), (6, "other text of its own", 5)], "doc_id long, text string, sid int")
    rows = sorted(((r.doc_id, r.component_id) for r in jj.jaccard_components(docs).collect()), key=str)
    assert rows == [(4, 4), (4, 4), (6, 6), (None, 4), (None, None)]
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns and {r.sid for r in kept.collect()} >= {2, 5}


def test_one_row_of_each_component_stays(spark):
    rows = [(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (None, "x", 4), (6, "other text of its own", 5), (4, "yet another text here", 6)]
    rows += [(7, "", 7), (7, " ", 8), (8, "", 9), (None, "", 10), (None, "", 11), (None, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int").repartition(3)
    kept = sorted(r.sid for r in jj.one_of_each(docs).collect())
    assert kept[:4] == [2, 4, 5, 6] and sorted({8: 7, 11: 10}.get(x, x) for x in kept[4:]) == [7, 9, 10, 12], kept


def test_word_hashes_depend_on_words_only():
    import pyarrow as pa

    texts = ["Ab cd", " ab\tCD\n", None, "", "abcd", "ab cdx", "é É", "x" * 3_000_000 + " ab cd " * 200_000, "x" * 3_000_000]
    got = [h.tolist() for h in jj.words_of(pa.array(texts))]
    assert got[0] == got[1] and len(got[0]) == 2 and got[2] == got[3] == [] and len(got[6]) == 2 and got[6][0] != got[6][1]
    assert len(got[7]) == 400_001 and got[7][1:3] == got[0] and got[7][0] == got[8][0]
    assert len({h for x in got for h in x}) == 7
    assert [h.tolist() for h in jj.words_of(pa.array(["zz", *texts]).slice(1))] == got
