import http.server
import json
import struct
import threading

import numpy as np
import pytest
from millrace import queries
from millrace.functions import scalar
from millrace.operators import iterate
from millrace.operators.flow import Flow
from millrace.operators.keyed import KeyedFlow
from millrace.operators.linalg import Matrix, Vector
from millrace.plans.explain import info, plans
from millrace.plans.pipeline import Pipeline, Registry
from millrace.sources import files, http as http_source
from millrace.streaming import windows
from pyspark.sql import functions as F


def kv(spark, rows, schema="k string, v long"):
    return KeyedFlow(spark.createDataFrame(rows, schema))


# --- flows


def test_empty_and_null_keys(spark):
    none = kv(spark, [])
    assert none.reduce_by_key("sum").collect() == [] and none.count().collect()[0].n == 0
    assert none.reduce("sum", "v").collect()[0].value is None and none.fold(5, "sum", "v").collect()[0].value == 5
    assert none.top(3, "v").collect() == [] and none.zip_with_index("k").collect() == []
    some = kv(spark, [(None, 1), (None, 2), ("a", 3)])
    assert {(r.k, r.v) for r in some.reduce_by_key("sum").collect()} == {(None, 3), ("a", 3)}
    assert some.join_by_key(some).count().collect()[0].n == 1
    assert {(r.k, len(r.left), len(r.right)) for r in some.cogroup_by_key(kv(spark, [(None, 9), ("b", 1)])).collect()} == {(None, 2, 1), ("a", 1, 0), ("b", 0, 1)}


def test_cogroup_keeps_null_values_and_shuffles_once(spark):
    g = kv(spark, [("a", None), ("a", 1)]).cogroup_by_key(kv(spark, [("a", None), ("b", 2)]))
    assert plans(g.df).physical.count("Exchange") == 1
    assert {r.k: (sorted(r.left, key=str), r.right) for r in g.collect()} == {"a": ([1, None], [None]), "b": ([], [2])}


def test_zip_with_index_when_partitions_are_coalesced(spark):
    f = files.parallelize(spark, [(i * 7919 % 3000, "x" * (i % 50)) for i in range(3000)], "k long, pad string", 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        assert sorted((r.idx, r.k) for r in f.zip_with_index("k").collect()) == [(i, i) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_duplicate_keys_join_as_a_product(spark):
    a, b = kv(spark, [("x", 1), ("x", 2), ("y", 3)]), kv(spark, [("x", 10), ("x", 20), ("z", 1)])
    assert sorted((r.v.left, r.v.right) for r in a.join_by_key(b).collect()) == [(1, 10), (1, 20), (2, 10), (2, 20)]
    assert sorted((r.k, r.v.right) for r in a.join_by_key(b, "full").collect() if r.v.left is None) == [("z", 1)]


def test_order_is_total(spark):
    rng = np.random.default_rng(0)
    xs = [int(x) for x in rng.integers(-(2**31), 2**31 - 1, 5000)] + [-(2**31)] * 3
    f = files.parallelize(spark, xs, "x long", 7)
    assert [r.x for r in f.sort_by("x").collect()] == sorted(xs)
    assert [r.x for r in f.sort_by("x", ascending=False).collect()] == sorted(xs, reverse=True)
    assert [r.x for r in f.top(10, "x").collect()] == sorted(xs, reverse=True)[:10]
    assert [r.x for r in f.sort_with(lambda a, b: (a.x % 10 > b.x % 10) - (a.x % 10 < b.x % 10) or (a.x > b.x) - (a.x < b.x)).collect()] == sorted(xs, key=lambda x: (x % 10, x))
    got = [(r.idx, r.x) for r in f.zip_with_index("x").collect()]
    assert sorted(got) == list(enumerate(sorted(xs)))
    assert sorted(r.idx for r in f.zip_with_index().collect()) == list(range(len(xs)))


def test_top_is_planned_as_one_step(spark, sf_dir):
    text = plans(Flow(spark.read.parquet(f"{sf_dir}/orders.parquet")).top(5, "o_totalprice").df).physical
    assert "TakeOrderedAndProject" in text


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    f = Flow(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).key_by("l_suppkey", "l_tax").find_by_key(lambda k: k == 3).reduce_by_key("sum")
    text = plans(f.df).physical
    assert "EqualTo(l_suppkey,3)" in text and "ReadSchema: struct<l_suppkey:bigint,l_tax:double>" in text
    grouped = Flow(spark.read.parquet(f"{sf_dir}/events.parquet")).group_by("event_type", "value").find_by_key(lambda k: k == "view")
    assert "EqualTo(event_type,view)" in plans(grouped.df).physical


def test_partitioners(spark):
    f = files.parallelize(spark, range(1000), "x long", 3)
    for kind in ("hash", "range", "round_robin", "random", "prefix"):
        g = f.partition(kind, 5, *(() if kind in ("round_robin", "random") else ("x",))) if kind != "prefix" else f.map(x=lambda r: r.x.cast("string")).partition("prefix", 5, "x")
        assert sorted(int(r.x) for r in g.collect()) == list(range(1000)) and g.df.rdd.getNumPartitions() <= 5
    assert f.partition("keep") is f
    with pytest.raises(ValueError):
        f.partition("other", 3)
    parts = f.partition("range", 4, "x").df.select("x", F.spark_partition_id().alias("p")).collect()
    assert [r.p for r in sorted(parts)] == sorted(r.p for r in parts)
    assert f.with_parallelism(2).df.rdd.getNumPartitions() == f.with_parallelism(2, shuffle=False).df.rdd.getNumPartitions() == 2
    assert f.with_parallelism(7).df.rdd.getNumPartitions() == 7 and f.with_parallelism(7, shuffle=False).df.rdd.getNumPartitions() == 3


def test_samples(spark):
    f = files.parallelize(spark, range(1000), "x long", 8)
    a, b = ([r.x for r in f.sample_fraction(0.25, 3, exact=True).collect()] for _ in range(2))
    assert len(set(a)) == 250 and sorted(a) == sorted(b)
    assert 150 < f.sample_fraction(0.25).count().collect()[0].n < 350
    assert f.sample_n(7).count().collect()[0].n == 7


def test_reducers(spark):
    g = kv(spark, [("a", 3), ("a", 4), ("b", 5)])
    assert {r.k: r.v for r in g.reduce_by_key(lambda x, y: x * y).collect()} == {"a": 12, "b": 5}
    assert {r.k: r.v for r in g.reduce_by_key("product").collect()} == {"a": 12.0, "b": 5.0}
    grouped = g.group_by_key()
    for how, want in (("sum", {"a": 7, "b": 5}), ("min", {"a": 3, "b": 5}), ("count", {"a": 2, "b": 1}), ("avg", {"a": 3.5, "b": 5.0}), (lambda x, y: F.greatest(x, y), {"a": 4, "b": 5})):
        assert {r.k: r.v for r in grouped.reduce_values(how).collect()} == want
    assert sorted((r.k, r.v) for r in grouped.ungroup().collect()) == [("a", 3), ("a", 4), ("b", 5)]
    with pytest.raises(ValueError):
        g.reduce_by_key("median of medians")


def test_actions(spark):
    f = files.parallelize(spark, range(50), "x long", 4)
    assert f.compute().result(60).count().collect()[0].n == 50
    assert sum(r.x for r in f.traverse()) == sum(r.x for r in f.collect(60)) == 1225
    t = f.trace()
    assert t.rows == 50 and t.seconds > 0 and t.plans.physical
    assert f.explain().optimised and info(f.df)["columns"] == [("x", "bigint")]
    f.foreach(lambda r: None)


def sent_to_driver(spark, run):
    """What ``run`` gives, and the bytes of results that the tasks of its jobs sent."""
    sc = spark.sparkContext._jsc.sc()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]

    def jobs():
        sc.listenerBus().waitUntilEmpty()
        return {j.jobId(): set(listed(j.stageIds())) for j in listed(sc.statusStore().jobsList(None))}

    before = jobs()
    out = run()
    stages = set().union(*[s for j, s in jobs().items() if j not in before])
    return out, sum(sc.statusStore().lastStageAttempt(s).resultSize() for s in stages)


def actions_over(spark, folder, orders):
    orders.write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(0,)], "r_regionkey long").write.parquet(f"{folder}/region.parquet")
    rows, sent = sent_to_driver(spark, lambda: queries.QUERIES["actions"](spark, str(folder)).collect())
    return [tuple(r) for r in rows], sent


def test_actions_query_sends_a_total_for_each_partition(spark, tmp_path):
    sent = {}
    for n in (8_000, 800_000):
        rows, sent[n] = actions_over(spark, tmp_path / str(n), spark.range(0, n, 1, 4).withColumnRenamed("id", "o_orderkey"))
        assert rows == [(n, n * (n - 1) // 2, n)]
    assert sent[800_000] < 2 * sent[8_000]  # rows would be 20 bytes each


@pytest.mark.parametrize("keys, want", [([], (0, None, 0)), ([None], (1, None, 1)), ([2**60 + 1, None, -3], (3, 2**60 - 2, 3))])
def test_actions_query_on_nulls_and_no_rows(spark, tmp_path, keys, want):
    assert actions_over(spark, tmp_path, spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))[0] == [want]


def test_cogroup_apply(spark):
    import pandas as pd

    out = kv(spark, [("a", 1), ("b", 2)]).cogroup_apply(kv(spark, [("a", 5)]), lambda a, b: pd.DataFrame([(len(a), len(b))], columns=["x", "y"]), "x long, y long")
    assert sorted(map(tuple, out.collect())) == [(1, 0), (1, 1)]


# --- scalar functions


def test_scalar(spark):
    df = spark.createDataFrame([("a,b,,", "12.5"), ("", "x"), (",a", "7"), (",,", "1")], "s string, n string")
    rows = df.select(scalar.split_trimmed(F.col("s"), ",").alias("p"), scalar.to_number(F.col("n")).alias("n"), scalar.full_match(F.col("n"), r"\d+(.\d+)?").alias("m"), scalar.dropped(F.split("s", ","), 1, 1).alias("d")).collect()
    assert [r.p for r in rows] == [["a", "b"], [""], ["", "a"], []]
    assert [r.n for r in rows] == [12.5, None, 7.0, 1.0] and [r.m for r in rows] == [True, False, True, True]
    assert [r.d for r in rows] == [["b", ""], [], [], [""]]


# --- vectors, matrices, loops


def test_vectors(spark):
    a, b = Vector.local(spark, [1, 2, 3, 4]), Vector(spark.createDataFrame([(2, 10.0), (7, 5.0)], "idx long, value double"))
    of = lambda v: {r.idx: r.value for r in v.df.collect()}
    assert of(a + b) == {0: 1, 1: 2, 2: 13, 3: 4, 7: 5} and of(a * b) == {0: 0, 1: 0, 2: 30, 3: 0, 7: 0} and of(a - b) == {2: -7}
    assert of(a.concat(b)) == {0: 1, 1: 2, 2: 3, 3: 4, 6: 10, 11: 5} and of(a.slice(1, 2)) == {1: 2, 2: 3} and of(a.slice(3)) == {3: 4}
    assert a.inner([1, 1, 1, 1]).collect()[0].value == 10 and of(a.add([1.0])) == {0: 2, 1: 2, 2: 3, 3: 4}
    empty = Vector.local(spark, [])
    assert empty.sum().collect()[0].value is None and empty.size().collect()[0].n == 0


def test_matrix_and_learning(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(60, 5)), rng.normal(size=5)
    y = np.where(x @ w > 0, 1.0, -1.0)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "row long, vec array<double>, y double").cache()
    m = Matrix.of(df, "row", "vec")
    assert np.allclose([r.value for r in m.dot(w.tolist()).df.orderBy("idx").collect()], x @ w)
    assert np.allclose([r.vec for r in m.norm().df.orderBy("row").collect()], (x - x.mean(0)) / np.sqrt((x**2).sum(0)))
    assert m.num_columns().collect()[0].n == 5
    lin, log = np.zeros(5), np.zeros(5)
    for _ in range(4):
        lin -= 0.1 * x.T @ (x @ lin - y) / 60
        log -= 0.1 * x.T @ ((1 / (1 + np.exp(-y * (x @ log))) - 1) * y) / 60
    assert np.allclose(iterate.descend(df, "vec", "y", iterate.linear_gradient, [0.0] * 5, 4, 0.1, mean=True), lin)
    assert np.allclose(iterate.descend(df, "vec", "y", iterate.logistic_gradient, [0.0] * 5, 4, 0.1, mean=True), log)
    c = x[:3].copy()
    for _ in range(3):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
    assert np.allclose(iterate.kmeans(df, "vec", x[:3].tolist(), 3), c)


def test_loops(spark):
    assert iterate.repeat(5, 1, lambda x: x * 2) == 32
    assert iterate.repeat_while(1, lambda x: x < 100, lambda x: x * 3) == 243
    assert iterate.tail_recursive(0, lambda x: (x >= 4, x + 1)) == 5
    assert iterate.repeat_while(0, lambda x: x < 5000, lambda x: x + 1) == 5000
    with pytest.raises(RuntimeError):
        iterate.repeat_while(0, lambda x: True, lambda x: x + 1, most=10)
    out = iterate.repeat_table(3, spark.range(3).toDF("x"), lambda d: d.selectExpr("x + 1 AS x"))
    assert sorted(r.x for r in out.collect()) == [3, 4, 5] and "FileScan" in plans(out).physical


# --- sources, sinks, pipelines, streams


def test_files(spark, tmp_path):
    (tmp_path / "rank.csv").write_text("u1,1.5,2\nu2,x,3\n")
    f = files.fields(spark, str(tmp_path / "rank.csv"), "url string, rank double, duration double")
    assert [(r.url, r["rank"]) for r in f.sort_by("url").collect()] == [("u1", 1.5), ("u2", None)]
    parts = files.split_lines(files.text(spark, str(tmp_path / "rank.csv")), ",", url=(0, "string"), rank=(1, "double"), no=(9, "string"))
    assert [tuple(r) for r in parts.sort_by("url").collect()] == [("u1", 1.5, None), ("u2", None, None)]
    (tmp_path / "a.json").write_text(json.dumps([{"url": f"u{i}", "ranking": i / 2} for i in range(10)], indent=1))
    j = files.json(spark, str(tmp_path / "a.json"), "url string, ranking float")
    assert sum(r.ranking for r in j.collect()) == 22.5
    for form in ("parquet", "json", "csv", "orc"):
        files.write(j, str(tmp_path / form), form)
        assert spark.read.schema("url string, ranking float").format(form).load(str(tmp_path / form)).count() == 10
    (tmp_path / "x.bin").write_bytes(struct.pack("<3i", 4, 5, 6))
    b = files.from_url(spark, str(tmp_path / "x.bin"), lambda raw: [(v,) for (v,) in struct.iter_unpack("<i", raw)], "v int")
    assert sorted(r.v for r in b.collect()) == [4, 5, 6] and files.from_url(spark, str(tmp_path / "x.bin")).collect()[0].length == 12


def test_local_sources(spark):
    assert [tuple(r) for r in files.parallel_with_index(spark, ["a", "b"], "x string", 5).sort_by("idx").collect()] == [(0, "a"), (1, "b")]
    h = files.horizontal(spark, "x long", [1, 2], [3], [])
    assert sorted(r.x for r in h.collect()) == [1, 2, 3]


def test_bucketed_tables_join_without_a_shuffle(spark):
    f = files.parallelize(spark, [(i, i * 2) for i in range(1000)], "k long, v long")
    files.save_bucketed(f, "bucketed_a", ["k"], 4)
    files.save_bucketed(f, "bucketed_b", ["k"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert "Exchange" not in plans(j).physical and j.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_http(spark):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"one\ntwo\n")

        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert sorted(r.value for r in http_source.http_lines(spark, url, url).collect()) == ["one", "one", "two", "two"]
        http_source.http_post(spark.createDataFrame([(i,) for i in range(5)], "x long").coalesce(1), url, 2)
        assert sorted(x["x"] for batch in got for x in batch) == list(range(5)) and len(got) == 3
        assert http_source.get(url) == b"one\ntwo\n"
    finally:
        server.shutdown()


def test_pipeline(spark, tmp_path):
    p = Pipeline("double", "1", lambda s: s.range(10).toDF("x")).then("double", lambda d: d.selectExpr("x * 2 AS x")).into(lambda d: files.write(d, str(tmp_path / "out")))
    r = Registry()
    r.submit(p)
    r.submit(Pipeline("double", "2", p.source))
    assert r.get("double", "1").run(spark).count() == 10 and spark.read.parquet(str(tmp_path / "out")).agg({"x": "sum"}).collect()[0][0] == 90
    for v in ("10", "9"):
        q = Registry()
        for w in ("9", "10", "2.1"):
            q.submit(Pipeline("x", w, p.source))
        assert q.get("x").version == "10" and q.versions("x") == ["2.1", "9", "10"], v
    assert r.versions("double") == ["1", "2"] and r.get("double").version == "2" and p.trace(spark).rows == 10
    with pytest.raises(KeyError):
        r.get("none")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    kept = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema, 100).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.tumbling(stream, "1 hour", "1 hour").writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.sql("SELECT start, event_type, max(n) AS n FROM hours GROUP BY ALL").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windows.tumbling(kept).collect()}


def test_functions_are_combined_inside_partitions(spark):
    rows = [(i % 3 if i % 7 else None, float(i) if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    keyed = Flow(df).key_by("k", "v")
    got = {r.k: r.v for r in keyed.reduce_by_key(lambda a, b: a + b).df.collect()}
    want = {k: sum(v or 0 for q, v in rows if q == k) for k in (0, 1, 2, None)}
    assert got == want
    plan = keyed.reduce_by_key(max).df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 2
    assert {r.k: r.v for r in keyed.fold_by_key(1000.0, lambda a, b: a + b).df.collect()} == {k: v + 1000 for k, v in want.items()}
    assert Flow(df).reduce(max, "v").df.collect()[0].value == 999 and Flow(df.limit(0)).reduce(max, "v").df.collect()[0].value is None
    structs = spark.createDataFrame([((1, "a"), 1), ((1, "a"), 2), ((2, None), 3)], "k struct<x:int,y:string>, v int")
    assert sorted((r.k.x, r.v) for r in Flow(structs).key_by("k", "v").reduce_by_key(lambda a, b: a * 10 + b if a < b else b * 10 + a).df.collect()) == [(1, 12), (2, 3)]
    nan = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2)], "k double, v int").repartition(2)
    assert [r.v for r in Flow(nan).key_by("k", "v").reduce_by_key(lambda a, b: a + b).df.collect()] == [3]


def test_many_keys_pass_on(spark, monkeypatch):
    from millrace.operators import aggregate

    df = spark.range(5000).selectExpr("id % 1000 AS k", "id AS v")
    run = aggregate._states(aggregate.reducing(lambda a, b: a + b))
    import pyarrow as pa

    monkeypatch.setattr(aggregate, "MAX_KEYS", 100)
    batches = [pa.RecordBatch.from_pylist([{"k": i % 300, "v": i} for i in range(j, j + 500)]) for j in range(0, 2000, 500)]
    assert len(list(run(iter(batches)))) > 1
    assert Flow(df).key_by("k", "v").reduce_by_key(lambda a, b: a + b).df.agg({"v": "sum"}).collect()[0][0] == sum(range(5000))


def test_zero_of_every_named_fold(spark):
    f = Flow(spark.createDataFrame([(3, True, "b"), (5, True, "a")], "x int, b boolean, s string"))
    one = lambda zero, how, c, g=f: g.fold(zero, how, c).df.collect()[0].value
    assert (one(100, "count", "x"), one(False, "bool_and", "b"), one(True, "bool_or", "b"), one(10, "sum", "x"), one(2, "product", "x"), one(9, "max", "x"), one(1, "min", "x")) == (102, False, True, 18, 30, 9, 1)
    assert (one(8, "bit_or", "x"), one(1, "bit_and", "x"), one(1, "bit_xor", "x"), one("z", "concat", "s")) == (15, 1, 7, "zab")
    none = Flow(f.df.limit(0))
    assert (one(4, "max", "x", none), one(4, "count", "x", none), one("z", "concat", "s", none)) == (4, 4, "z")
    with pytest.raises(ValueError):
        f.fold(0, "first", "x")
    assert f.fold(100, lambda a, b: a - b, "x").df.collect()[0].value in (98, 102) and none.fold(7, max, "x").df.collect()[0].value == 7


def test_full_match_is_of_the_whole_text(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("ab",), ("x\nabc",)], "s string")
    assert [r[0] for r in df.select(scalar.full_match(F.col("s"), "abc|ab")).collect()] == [True, False, True, False]


def test_schema_with_commas_of_its_own(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    from decimal import Decimal

    out = files.from_url(spark, str(tmp_path / "x.bin"), lambda raw: [(Decimal("1.25"), {"a": 1, "b": "x"})], "d decimal(10,2), s struct<a:int,b:string>").collect()
    assert out[0].d == Decimal("1.25") and out[0].s.b == "x"


def test_equal_rows_are_dealt_over_tasks(spark):
    df = spark.createDataFrame([(5,)] * 900 + [(i,) for i in range(100)], "x int").repartition(8)
    out = Flow(df).sort_with(lambda a, b: (a.x > b.x) - (a.x < b.x)).df
    assert [r.x for r in out.collect()] == sorted([5] * 900 + list(range(100)))
    assert max(out.rdd.glom().map(len).collect()) < 500


def test_grouped_reductions_make_no_lists(spark, sf_dir):
    from millrace import queries

    for name in ("reduce_values", "find_values_by_key", "find_by_key", "group_map_values"):
        assert "collect_list" not in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name


def test_stored_tables_are_released(spark):
    import os

    from millrace import tables

    df = tables.stored(spark.range(10).toDF("x"), "test")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 10
    assert tables.release(spark) >= 1 and not os.path.exists(path) and tables.release(spark) == 0
