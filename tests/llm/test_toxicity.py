import zlib

import numpy as np
import pytest
from millrace.llm import queries, toxicity


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    rows = [("the idiot said the stupid clown lost worthless trash and hello again to you all " * 30,)]
    return toxicity.language_model(spark.createDataFrame(rows, "text string"))


def test_language_model_is_a_distribution_and_counts_all(spark, model):
    p = np.exp(model)
    assert np.allclose(p.sum(axis=2)[:, :], 1, atol=0.02)
    more = toxicity.language_model(spark.createDataFrame([("zq zq zq",)] * 50 + [(None,), ("",)], "text string"))
    assert more[0][26][17] > model[0][26][17]


@pytest.mark.parametrize(
    "token, word",
    [("1d10t", "idiot"), ("st*u*p*i*d", "stupid"), ("iiidiooot", "idiot"), ("tr@$h", "trash"), ("cl0wn!!!", "clown"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("hello", "hello"), ("worthless", "worthless"), ("scum***", "scum"), ("2024", ""), ("###", ""), ("stuupid", "stupid"), ("iddiot", "idiot")],
)
def test_decoding(model, token, word):
    assert toxicity.Restored(model)[token] == word


def test_spaced_words(model):
    known = toxicity.Restored(model)
    assert "idiot" in toxicity.restored_words("you i d i o t there", known)
    assert "idiot" in toxicity.restored_words("you I.D.1.0.T there", known)
    assert "stupid" in toxicity.restored_words("you $ t u p i d there", known)
    assert {"idiot", "clown"} <= toxicity.restored_words("i d i o t c l 0 w n", known)
    assert {"you", "idiot"} <= toxicity.restored_words("y o u i d i o t", known)
    assert "you" in toxicity.restored_words("hello y-o-u there", known)
    assert toxicity.restored_words("a b", known) == {"a", "b"}
    assert toxicity.restored_words("", known) == set()


def brute_best(token, model, spaced=False):
    """All readings of a token, scored one by one."""
    best = None
    readings = [("", 0.0)]
    for options in toxicity.lattice(token, spaced):
        readings = [(r + x, c + k) for r, c in readings for x, k in options]
    for read, cost in readings:
        s, x, y = -cost, 0, 0
        for ch in read:
            z = toxicity._code(ch)
            s, x, y = s + model[x][y][z], *((y, z) if z else (0, 0))
        s += model[x][y][0]
        best = max(best or (s, read), (s, read))
    return best[1]


@pytest.mark.parametrize("token", ["1d!0t", "$tup1d", "b1tt3rrr", "a|!a", "x@@y!!", "ééé1l0"])
def test_viterbi_finds_the_best_reading(model, token):
    assert toxicity.decode(token, model.tolist()) == brute_best(token, model.tolist())
    spaced = " ".join(token)
    assert toxicity.decode(spaced, model.tolist(), True) == brute_best(spaced, model.tolist(), True)


def test_single_paths_need_no_decoding(model):
    for token in ("hello", "garden", "worthles", "éàü", "abcdefghij"):
        assert toxicity._DOUBLE.search(token) or toxicity.decode(token, model.tolist()) == token


def test_characters_beyond_ascii_are_one_letter_each_or_none(spark):
    """What is counted is what is decoded: characters, of either case, not bytes."""
    a = toxicity.language_model(spark.createDataFrame([("aéb É😀c ’tis “q”",)], "text string"))
    counts = {}
    for word in ("aéb", "é", "c", "tis", "q"):
        codes = [0, 0, *map(toxicity._code, word), 0]
        for k in zip(codes, codes[1:], codes[2:], strict=False):
            counts[k] = counts.get(k, 0) + 1
    assert toxicity._code("É") == toxicity._code("é") == 27 and toxicity._code("😀") == toxicity._code("’") == 0
    # a trigram that was seen is likelier than one of its context that wasn't
    for x, y, z in counts:
        if y or z:
            assert a[x][y][z] > min(a[x][y])


def brute_score(docs, labels):
    """Training and scores without Spark, by plain gradient ascent on the same penalised likelihood. docs, labels: (id, value)."""
    codes = np.zeros((28, 28, 28))
    for _, t in docs:
        c = [0, 0, *map(toxicity._code, t or ""), 0]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            codes[x, y, z] += y > 0 or z > 0
    two = codes.sum(axis=0, keepdims=True) + 0.5
    model = np.log((codes + 5 * two / two.sum(axis=2, keepdims=True)) / (codes.sum(axis=2, keepdims=True) + 5))
    known = toxicity.Restored(model)
    words = {i: toxicity.restored_words(t or "", known) for i, t in docs}
    train = {i: y for i, y in labels if i in words and zlib.crc32(str(i).encode()) % 5}
    n1, n = sum(train.values()), len(train)
    seen = {}
    for i, y in train.items():
        for w in words[i]:
            seen.setdefault(w, [0, 0])[1 - y] += 1
    rank = []
    for w, (a, b) in seen.items():
        if a + b >= toxicity.MIN_DOCS:
            share = (a + b) / n
            rank.append((-round(abs((a / n1 - b / (n - n1)) / (share * (1 - share + 1e-9) * (1 / n1 + 1 / (n - n1))) ** 0.5), 9), w))
    chosen = [w for _, w in sorted(rank)[: toxicity.FEATURES]]
    x = np.array([[float(w in words[i]) for w in chosen] + [1.0] for i in train])
    y, ridge = np.array(list(train.values()), float), np.array([toxicity.RIDGE] * len(chosen) + [1e-6])
    w = np.zeros(len(chosen) + 1)
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + toxicity.RIDGE)
    was = w
    for k in range(60_000):  # accelerated
        ahead = w + (k / (k + 3)) * (w - was)
        p = 1 / (1 + np.exp(-x @ ahead))
        was, w = w, ahead + step * (x.T @ (y - p) - ridge * ahead)
    return {i: 1 / (1 + np.exp(-sum(v for c, v in zip(chosen, w, strict=False) if c in words[i]) - w[-1])) for i, _ in docs}


def test_scores_match_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    want = brute_score(docs, labels)
    for r in queries.op9_toxicity(spark, sf_dir).collect():
        assert abs(r.score - want[r.doc_id]) < 0.01, (r.doc_id, r.score, want[r.doc_id])


def test_many_rows_under_one_labelled_id(spark):
    """Of each labelled id one text trains, whatever the number of its rows."""
    rows = [(i, "good plain words" if i % 2 else "vile nasty words") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    one = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    many = toxicity.score(spark.createDataFrame(rows + [rows[1]] * 500, "doc_id long, text string"), labels).collect()
    model = {r.doc_id: r.predicted for r in one}
    assert all(r.predicted == model[r.doc_id] == 1 - r.doc_id % 2 for r in many) and len(many) == 560


def test_held_out_accuracy(spark):
    """On the larger table: held-out rows against their labels."""
    d = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op9_toxicity(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(out[x.doc_id].predicted, x.toxic) for x in labels if out[x.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_disguised_words_are_scored(spark):
    clean = "the quiet garden was open and the people walked along the old river again"
    rows = [(i, clean + (" you idiot" if i % 2 else f" number{i}")) for i in range(400)] + [(1000, clean + " you 1d10t"), (1001, clean + " i d i o t"), (1002, clean), (1003, None), (1004, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert got[1000] > 0.5 and got[1001] > 0.5 and got[1002] < 0.5 and 0 <= got[1003] == got[1004] <= 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), empty).count() == 0
    rows = toxicity.score(spark.createDataFrame([(1, "a", 2), (1, "a", 2), (None, None, 3)], "doc_id long, text string, score int"), empty).collect()
    assert len(rows) == 3 and {r.score for r in rows} == {0.5}
