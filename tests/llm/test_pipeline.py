import collections
import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
from millrace.llm import mixing
from tests.llm import test_jaccard_join, test_line_dedup, test_mixing, test_packing, test_quality

W = r"[^\x20\x09-\x0D]+"


def without_frequent_lines(docs):
    """docs: (id, text, source); those that the quality rules keep, without the lines above the limits."""
    lost, often, out = test_quality.brute_lost(docs), test_quality.brute_often(docs), []
    for d, t, s in docs:
        counts = test_quality.base(t)
        if not counts[-1] and lost[d] <= 0.7 * counts[0]:
            out.append((d, "\n".join(x for x in t.split("\n") if (s, test_quality.normal(x)) not in often), s))
    return out


def mixed(docs):
    """docs: (id, text, source); (position, id, copy, text) as often as taken, in the order of the run."""
    size = {d: len(re.findall(W, t)) for d, t, _ in docs}
    of = collections.defaultdict(list)
    for d, t, s in docs:
        of[s].append((hashlib.md5(f"{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), d, t))
    target, out = test_mixing.brute_targets({s: sum(size[d] for _, d, _ in x) for s, x in of.items()}), []
    slope = {s: mixing.SLOPES[i % 3] for i, s in enumerate(sorted(of))}
    words, tilt = sum(target.values()), sum(target[s] * slope[s] for s in of)

    def position(s, begun):
        share, k = begun / target[s], slope[s]
        t = share if k == 0 else (math.sqrt((1 - k) ** 2 + 4 * k * share) - (1 - k)) / (2 * k)
        return (words - tilt) * t + tilt * t * t

    for s, x in of.items():
        total, goal, at = sum(size[d] for _, d, _ in x), math.floor(target[s] + 0.5), 0
        for _, d, t in sorted(x):
            epochs, more = goal // total, max(0, min(size[d], goal % total - at))
            for e in range(epochs):
                out.append((position(s, e * total + at), d, e, t))
            if more:
                cut = t if more == size[d] else re.match(r"[\x20\x09-\x0D]*", t)[0] + " ".join(re.findall(W, t)[:more])
                out.append((position(s, epochs * total + at), d, epochs, cut))
            at += size[d]
    return sorted(out)


def table_of(spark, sf_dir, folder):
    """The documents of the smallest tables, with pages of a site (shared blocks of lines, some depleted) and odd rows besides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    names, prose = docs.columns, test_quality.prose
    for i in range(70):
        block = [prose(9000 + j, 6) for j in range(4)]
        t = "\n".join([*block[:2], prose(500 + i, 5 if i % 5 == 0 else 40), *block[2:], "Imprint of this very site"])
        rows.append((10_000 + i, t, "en", "site", len(t)))
    rows += [(20_000, None, "en", "site", 0), (20_001, "", "en", "site", 0), (20_002, " \n", "en", "site", 2)]
    spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True))[c] for c in names) if r[0] >= 10_000 else r for r in rows], docs.schema).write.parquet(f"{folder}/documents.parquet")
    return [(d["doc_id"], d["text"], d["source"]) for d in (dict(zip(names, r, strict=True)) if r[0] < 10_000 else {"doc_id": r[0], "text": r[1], "source": r[3]} for r in rows)]


def test_matches_brute_force(spark, sf_dir, tmp_path):
    docs = table_of(spark, sf_dir, str(tmp_path))
    n = len(docs)
    docs = without_frequent_lines(docs)
    assert len(docs) < n and not any("very site" in t for _, t, _ in docs)
    left = test_line_dedup.brute({d: t for d, t, _ in docs})
    docs = [(d, left[d], s) for d, t, s in docs if left[d] == t or re.search(W, left[d])]
    component = test_jaccard_join.brute({d: t for d, t, _ in docs})
    docs = [x for x in docs if component[x[0]][1] == x[0]]
    want = {}
    for place, (_, d, _, t) in enumerate(mixed(docs)):
        ids, start = np.array(test_packing.ids(t), "<u4"), 0
        for n in test_packing.packing.binary_lengths(len(ids)):
            want[place, start] = (d, n, len(ids), zlib.crc32(ids[start : start + n].tobytes()), ids[start : start + n].tolist())
            start += n
    rows = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.sequence_id)
    assert len(rows) == len(want)
    got = {(r.position, r.start): (r.doc_id, r.length, r.doc_tokens, r.ids_crc32, r.ids) for r in rows}
    assert got == want
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    order = [(-r.length, r.position, r.start) for r in rows]
    assert order == sorted(order) and max(collections.Counter(r.doc_id for r in rows if r.start == 0).values()) > 1


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert all(len(r.text) == r.n_chars for r in out.collect()), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_odd_rows_in_every_stage(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and further columns with the names that stages use."""
    long = " ".join(f"w{i}" for i in range(120_000))
    some = " ".join(f"v{i}" for i in range(40))
    rows = [(None, None, None, None, None, 1, 1.0, "a"), (1, "", "en", "s", 0, 2, None, "b"), (2, long, "en", None, len(long), 3, 1.0, None), (2, long, "en", None, len(long), 3, 1.0, None), (2, some, None, "s", len(some), 4, 0.0, "c"), (None, some + " x", "en", "t", len(some) + 2, 5, 0.0, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k int, score double, row string"
    docs, kept = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
    assert sorted(r.k for r in kept["quality rules"]) == [3, 3, 4, 5]
    assert sorted(r.k for r in kept["line dedup"]) == [1, 2, 3, 3, 4, 5]
    assert sorted(r.k for r in kept["n-gram Jaccard join"]) in ([1, 2, 3, 4], [1, 2, 3, 5])
    assert {r.k for r in kept["mixing"]} <= {3, 4, 5} and kept["mixing"]
    assert sum(r.start == 0 for r in kept["packing"]) == 6 and {r.doc_tokens for r in kept["packing"] if r.start == 0} >= {1}
