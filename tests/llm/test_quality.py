import collections
import re

import __spark_entry__
from millrace.llm import quality, queries
from tests.oracle import compare

W = r"[^\x20\x09-\x0D]+"


def base(text):
    t = text or ""
    w = re.findall(W, t)
    lines = [x for x in t.split("\n") if re.search(W, x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


CASES = [None, "", " \n\t", "a", "a " * 7, "a " * 8, "a " * 9, "a b c d e f g h x a b c d e f g h", "😀 \x0b é\x0c#$\n\n😀 \x0b é\x0c#$", "x y\n" * 3000, " ".join(map(str, range(30000))), "one\x1ctwo\x85three\xa0four", "a\x00b c"]


def measured(spark, rows, schema="doc_id long, text string, source string", **more):
    return quality.measure(spark.createDataFrame(rows, schema), **more).collect()


def test_base_counts(spark, sf_dir):
    docs = [(i, t, "s") for i, t in enumerate(CASES)] + [(100 + r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in measured(spark, docs)}
    for i, t, _ in docs:
        assert got[i] == base(t), (i, (t or "")[:60])


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def prose(i, n=30):
    return " ".join(letters(i) + "x" + letters(j) for j in range(n))


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    menu = "home about contact imprint privacy terms sitemap search login register help press jobs blog shop news"
    rows = [(i, f"{menu}\n{prose(i)}", "a") for i in range(40)]
    rows += [(100 + i, f"{menu}\nown {letters(i)}\nq {letters(i)}", "a") for i in range(40)]
    rows += [(200 + i, prose(7) + "\n" + prose(8), "a") for i in range(60)]  # copies: not boilerplate
    rows += [(300, f"{menu}\n{prose(300)}", "b"), (301, f"{menu}\n{prose(301)}", None)]  # another host
    got = {r.doc_id: r for r in measured(spark, rows, max_docs=20)}
    assert all(got[i].kept and got[i].lost_words == 16 for i in range(40))
    assert not any(got[100 + i].kept or got[100 + i].base_failed for i in range(40))
    assert all(got[200 + i].kept and got[200 + i].lost_words == 0 for i in range(60))
    assert got[300].lost_words == 0 and got[301].lost_words == 0
    left = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=20).collect()}
    assert left[3] == prose(3) and 100 not in left and left[200] == rows[80][1] and len(left) == 40 + 60 + 2


def test_lines_shared_in_blocks_go(spark):
    """Every line that more documents than the limit share goes, however many lines they share and few they have of their own."""
    rows, want = [], {}
    for b, (shared, own) in enumerate([(5, 1), (10, 3), (3, 1), (20, 3)]):
        block = [prose(1000 * b + i, 8) for i in range(shared)]
        for d in range(60):
            mine = [prose(100_000 + 10_000 * b + 10 * d + i, 30) for i in range(own)]
            rows.append((1000 * b + d, "\n".join(block + mine), "a"))
            want[1000 * b + d] = 8 * shared
    assert {r.doc_id: r.lost_words for r in measured(spark, rows)} == want


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(re.findall(W, line.lower())))


def brute_often(docs, max_docs=50, min_shared=8, max_share=0.1):
    """docs: (id, text, host); the (host, line) above the limits, from the definition."""
    seen, of_host = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, h in docs:
        whole = tuple(x for x in map(normal, (t or "").split("\n")) if x)
        if whole:
            of_host[h].add(whole)
        for x in whole:
            seen[h, x].add(whole)
    return {k for k, s in seen.items() if len(s) > max_docs or len(s) >= min_shared and len(s) > max_share * len(of_host[k[0]])}


def brute_lost(docs):
    """id -> words in lines above the limits."""
    often = brute_often(docs)
    return {i: sum(len(x.split(" ")) for x in map(normal, (t or "").split("\n")) if x and (h, x) in often) for i, t, h in docs}


def test_verdicts_match_brute_force(spark):
    """The whole verdict, on a table where lines are above the limits and on one with boilerplate in blocks of 2, 6 and 10 lines, copies and nulls."""
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    made = [(i, None if i % 50 == 0 else t, s) for i, t, s in real[:100]]
    for b, (shared, own) in enumerate([(2, 1), (6, 3), (10, 5)]):
        block = [prose(1000 * b + i, 8) for i in range(shared)]
        for d in range(90):
            mine = [prose(100_000 + 10_000 * b + 10 * (d if d % 9 else 0) + i, 8) for i in range(own)]
            made.append((10_000 + 1000 * b + d, "\n".join(block + mine), ("a", "b", None)[d % 3]))
    for docs, least in ((real, 5), (made, 100)):
        want = brute_lost(docs)
        assert sum(x > 0 for x in want.values()) >= least
        got = {r.doc_id: (r.lost_words, r.kept) for r in measured(spark, docs)}
        for i, t, _ in docs:
            failed = base(t)
            assert got[i] == (want[i], not failed[-1] and want[i] <= 0.7 * failed[0]), i


def test_rows_with_nulls_are_told_apart(spark):
    rows = [(1, "A " + prose(5), None), (1, None, "A " + prose(5))]
    assert sorted(r.n_words for r in measured(spark, rows)) == [0, 31]


def test_short_lines_count(spark):
    menu = ["Home", "Contact us", "All rights reserved"]
    rows = [(i, "\n".join([*menu, prose(i)]), "a") for i in range(60)] + [(100 + i, "\n".join(menu * 5 + [prose(100 + i, 15)]), "a") for i in range(3)]
    got = {r.doc_id: (r.lost_words, r.base_failed) for r in measured(spark, rows)}
    assert all(got[i] == (6, False) for i in range(60)) and all(got[100 + i][0] == 30 for i in range(3))


def test_odd_tables(spark):
    assert measured(spark, []) == []
    rows = [(None, None, None, 1), (1, "a b", None, 1), (1, "a b", None, 1)]
    got = measured(spark, rows, "doc_id long, text string, source string, kept int")
    assert len(got) == 3 and not any(r.kept for r in got)
    assert quality.clean(spark.createDataFrame([(1, prose(1), None, 5), (1, prose(1), None, 5)], "doc_id long, text string, source string, k int")).columns == ["doc_id", "text", "source", "k"]


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op1_quality_rules", sf_dir) > 0


def test_query(spark, sf_dir):
    out = queries.op1_quality_rules(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and sum(r.kept for r in out) > 0.8 * len(out)
