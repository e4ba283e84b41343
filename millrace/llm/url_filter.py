"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is fitted on a small table of labelled URLs (``labelled_urls``, at most ``MAX_LABELLED`` rows) by
``pyspark.ml``; scoring is one array expression, so no shuffle and no Python on the executors.

The training table is made by a rule from words that unwanted sites like to have in their names, from everyday words and from invented names; no
url of the data is in it. Names of words that were only seen with other partners are told (tests: recall of 0.9 or more on
held-out families).

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the model; very long urls are read whole; an empty
table gives an empty result; repeated rows are judged alike, each on its own; other columns are kept, but for those named host, path, score, rule
and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import UPPER, let

#: (verdict, host, path): a rule fits its host and all subdomains when the url's path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BUCKETS = 1 << 14
RIDGE = 0.00001
#: how much more an unwanted url weighs when training
BAD_WEIGHT = 6.0
NGRAMS = (3, 4)
MAX_LABELLED = 2500


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.when(known, F.regexp_replace(url, r"\A(?s:.*?)://", "")).otherwise("")
    raw = F.regexp_extract(after, r"\A[^/?#]*", 0)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, UPPER.lower()), path


#: words of the training table: in the names of unwanted sites, and of others
BAD = "casino poker slots betting jackpot viagra pharmacy pills meds loans payday credit crypto adult porn xxx cams dating singles replica watches cheap discount free bonus prize winner win click spam ads adserver banner popup tracker tracking warez torrent crack keygen malware".split()
GOOD = "library history garden news weather museum school recipes travel music science sports health city park maps forum wiki books journal photos market river bakery hotel church theatre cinema archive blog shop studio clinic bank law art design code data town".split()


def families(words: list[str], steps=(1, 4, 9, 13, 17, 22, 27)) -> list[str]:
    """Names of two words each, joined by a hyphen or nothing, and of some words with a letter."""
    pairs = [(w, words[(i + k) % len(words)]) for k in steps for i, w in enumerate(words)]
    return [a + "-" * (i % 3 > 0) + b for i, (a, b) in enumerate(pairs)] + [f"{w}-{'abcde'[i % 5]}" for i, w in enumerate(words)]


def mixed_families() -> list[str]:
    """An unwanted word beside an everyday one: unwanted."""
    return [w + "-" * (i % 3 > 0) + GOOD[(i * 5 + k) % len(GOOD)] for k in (0, 7, 19) for i, w in enumerate(BAD)]


def invented(n: int) -> list[str]:
    """Names without meaning: syllables, or letters, drawn by a fixed rule."""
    syllables = [c + v + e for c in "bcdfghklmnprstvz" for v in "aeiou" for e in ("", "n", "r", "l")]
    state, out = 12345, []
    for i in range(n):
        draws = []
        for _ in range(8):
            state = (state * 1103515245 + 12345) % 2**31
            draws.append(state >> 12)
        out.append("".join(syllables[d % len(syllables)] for d in draws[: 2 + i % 2]) if i % 2 else "".join(chr(97 + d % 26) for d in draws[: 5 + i % 4]))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: (url, 1 for unwanted)."""
    named = [(w, 1) for w in families(BAD) + mixed_families()] + [(w, 0) for w in families(GOOD) + GOOD + invented(400)]
    prefix, sites, pages = ("", "www.", "blog.", "m."), ("com", "net", "org", "info"), ("/", "/a/12", "/page.html", "/list/34/", "", "/x?y=1")
    rows = [(f"https://{prefix[(i + k) % 4]}{w}.{('example.', '')[k]}{sites[(i // 4 + k) % 4]}{pages[(i + 2 * k) % 6]}", y) for k in range(2) for i, (w, y) in enumerate(named)]
    return rows[:MAX_LABELLED]


def _features(host: Column, path: Column) -> Column:
    """Sorted distinct buckets of the character n-grams of ``^host path$``."""
    s = F.concat(F.lit("^"), host, path, F.lit("$"))
    grams = F.concat(*[F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in NGRAMS])
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))))


def fit(spark: SparkSession, labelled: list[tuple[str, int]], ridge: float = RIDGE) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept."""
    df = spark.createDataFrame(labelled[:MAX_LABELLED], "url string, label int").coalesce(1)
    host, path = url_parts(F.col("url"))
    df = df.select("label", _features(host, path).alias("b"))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="b", outputCol="c").setBinary(True)
    scaled = Normalizer(p=2.0, inputCol="c", outputCol="features")  # 1 / sqrt(buckets hit) each
    train = scaled.transform(counted.transform(df.select(F.transform("b", lambda i: i.cast("string")).alias("b"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, BAD_WEIGHT).otherwise(1.0).alias("weight"))))
    model = LogisticRegression(maxIter=100, regParam=ridge, standardization=False, weightCol="weight").fit(train.select("features", "label", "weight"))
    return [float(x) for x in model.coefficients], float(model.intercept)


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the model's probability that the url is unwanted)."""
    import numpy as np

    weights, bias = model or fit(pages.sparkSession, labelled_urls())
    host, path = url_parts(F.col(url))
    df = pages.withColumns({"host": host, "path": path})
    w = F.lit(np.asarray(weights, dtype="float64"))
    margin = let(_features(F.col("host"), F.col("path")), lambda b: F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(w, i)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    df = df.withColumns({"score": 1.0 / (1.0 + F.exp(-(margin + bias))), "rule": rule})
    return df.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
