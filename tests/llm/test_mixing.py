import collections

import __spark_entry__
import pytest
from millrace.llm import mixing, queries
from tests.oracle import compare


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op4_mix_curriculum", sf_dir) > 0


def brute_targets(sizes):
    """Targets by reshaping again and again."""
    keys = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: i % 3 + 1 for i, k in enumerate(keys)}
    cap, total, target, full = {k: 3.0 * sizes[k] for k in keys}, float(sum(sizes.values())), {}, set()
    while True:
        rest = total - sum(cap[k] for k in full)
        share = sum(w[k] for k in keys if k not in full)
        target = {k: cap[k] if k in full else rest * w[k] / share for k in keys}
        over = {k for k in keys if target[k] > cap[k] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, "c": 7, "d": 50, None: 3}, {"b": 10}, {"a": 0, "b": 9}, {"a": 100, "b": 100, "c": 100, "é": 2, "Z": 1}])
def test_targets_and_taken(spark, sizes):
    rows, i = [], 0
    for k, n in sizes.items():
        for part in range(0, n, 7):
            rows.append((i, " ".join(["w"] * min(7, n - part)), k, 1))
            i += 1
        rows.append((i, None, k, 1))
        i += 1
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target int"), bucket_rows=3).collect()
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-4 and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        assert sum(1 for _ in r.positions) == -(-r.taken // r.size if r.size else 0) and sorted(r.positions) == r.positions
        assert all(-1e-6 <= p <= sum(want.values()) + 1e-6 for p in r.positions)
    assert len(got) == len(rows) and all(abs(taken[k] - want[k]) <= 1 for k in sizes)


def test_curriculum(spark):
    """In every tenth of the run the sources have the shares that their schedules integrate to, and rows come in the order of positions."""
    rows = [(i, " ".join(["w"] * (3 + i % 5)), "abc"[i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.schedule(docs).collect()
    placed = [r for r in out if r.position is not None]
    assert [r.position for r in placed] == sorted(r.position for r in placed) and [r for r in out if r.position is None] == out[len(placed) :]
    target = {r.source: r.target for r in out}
    words, slopes = sum(target.values()), dict(zip("abc", mixing.SLOPES, strict=True))
    tilt = sum(target[s] * slopes[s] for s in target)
    time = lambda p: (((words - tilt) ** 2 + 4 * tilt * p) ** 0.5 - (words - tilt)) / (2 * tilt)  # noqa: E731  when the run has taken p words
    asked = lambda s, t: target[s] * ((1 - slopes[s]) * t + slopes[s] * t * t)
    each = collections.Counter()
    for r in mixing.mix(docs).collect():
        for k, p in enumerate(r.positions):
            each[min(9, int(10 * p / words)), r.source] += min(r.size, r.taken - k * r.size)
    for tenth in range(10):
        for s in target:
            want = asked(s, time(words * (tenth + 1) / 10)) - asked(s, time(words * tenth / 10))
            assert abs(each[tenth, s] - want) < 0.03 * words / 10, (tenth, s, each[tenth, s], want)
    assert each[0, "a"] > 3 * each[9, "a"] and each[9, "c"] > 3 * each[0, "c"]


def test_the_query_computes_positions(spark, sf_dir):
    df = queries.op4_mix_curriculum(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan.upper() and "Sort [position" in plan
    out = [r.position for r in df.collect()]
    assert [p for p in out if p is not None] == sorted(p for p in out if p is not None)


def test_ties_and_equal_ids(spark):
    """Null and equal ids with unlike texts: the result doesn't depend on the partitions, and their documents lie in many buckets."""
    rows = [(None if i % 2 else 7, f"w{i} " * (1 + i % 4), "a") for i in range(400)] + [(1, "x y", "b")] * 5
    a, b = ([(r.doc_id, r.size, r.taken, r.begins, r.position) for r in mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), bucket_rows=10).collect()] for n in (1, 7))
    assert sorted(a, key=repr) == sorted(b, key=repr) and len(a) == 405
    begins = [r.begins[0] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.begins and r.source == "a"]
    assert len(set(begins)) == len(begins) > 300


def test_mixed_documents(spark):
    rows = [(i, f" a{i}  b\nc d e ", "ab"[i % 2], 13, "x") for i in range(40)] + [(99, "only one", "z", 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, position string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    words = collections.Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
    assert words == taken and taken["z"] == 6


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(None, None, None)] * 2, "doc_id long, text string, source string")).collect()] == [0, 0]
