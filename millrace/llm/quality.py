"""Quality rules by cross-document line frequency, with the usual per-document counts.

Lines are normalised (trimmed, lower-cased, runs of digits and of white space made one) and hashed. For each host and line, however
short, the distinct documents are counted. Above the limits is a line in more than ``MAX_DOCS`` documents of the host, or in
``MIN_SHARED`` or more that are also over ``MAX_SHARE`` of the host's documents; it is removed, and a document that loses more than
``MAX_LOST`` of its words is rejected as depleted. Documents count as distinct by a hash of all their normalised lines, so
copies of one document count once, and documents that differ in any line are two.

Only counts and hashes are shuffled, never texts: (host, line, document) rows are pre-aggregated on the map side; the
join of lines with the frequent ones is an ordinary equi-join that adaptive execution can split where one line is hot.

Defined results: a null or empty text has zero counts, fails the base rules and is not kept; a null host is a host of its
own; repeated rows each get a result (and count once); an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import NOT_SPACE, let, words
from millrace.tables import stored

MAX_DOCS = 50
MIN_SHARED = 8
MAX_SHARE = 0.1
MAX_LOST = 0.7
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]++", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(F.filter(lines(text), lambda x: x.rlike(NOT_SPACE)), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _repeat_words(w: Column, size: int = WINDOW) -> Column:
    """w: the words of a text; how many stand in windows of ``size`` words (an even number) that occur twice or more, first occurrence included.

    Windows are compared by 64-bit hashes. One that occurs again has all its half-sized windows again, so these are counted first:
    few texts get further.
    """
    half, zero = size // 2, F.lit(0).cast("long")
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    halves = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - half), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(half)]))
    wholes = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - half), F.slice(a, F.lit(half + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))
    again = lambda h: F.size(h) - F.size(F.array_distinct(h))

    def starts(s: Column) -> Column:
        """s: windows with their starts, sorted; a window is repeated if it equals a neighbour."""
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | (F.when(i > 0, same(i, i - 1)).otherwise(False)))
        return F.array_sort(F.transform(hit, lambda i: F.get(s, i)["i"]))

    def covered(at: Column) -> Column:
        """at: sorted starts of repeated windows; what they cover together."""
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")

    sort = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: F.when(again(h) > 0, let(sort(h), lambda s: let(starts(s), covered))).otherwise(zero)
    some = lambda a: F.when(again(a) > size - half, let(wholes(a), count)).otherwise(zero)
    return F.when(F.size(w) <= size, zero).otherwise(let(let(hashed, halves), some))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars (code points in words) and n_repeat_words; the words are found once."""
    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))


def normalised_lines(text: Column) -> Column:
    """The lines, lower-cased, runs of digits made ``0``, runs of white space one blank, trimmed."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(F.regexp_replace(t, "[0-9]+", "0"), "\n", -1), lambda x: F.trim(x))


def _line_rows(docs: DataFrame, text: str, host: str, key: Column) -> DataFrame:
    """key, line number, words, hash within the host, hash of the whole document; of lines with words."""
    hashed = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    filled = F.filter(F.transform(normalised_lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), F.when(x == "", 0).otherwise(blanks(x) + 1).cast("long").alias("w"), hashed(x).alias("h"))), lambda x: x["w"] > 0)

    def signed(ls: Column) -> Column:
        return let(F.xxhash64(F.transform(ls, lambda x: x["h"])), lambda d: F.transform(ls, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), x["h"].alias("h"), d.alias("doc"))))

    df = docs.select(key.alias("k"), F.xxhash64(F.col(host).isNull(), F.col(host)).alias("hk"), F.explode(let(filled, signed)).alias("x"))
    return df.select("k", "hk", F.col("x.i").alias("i"), F.col("x.w").alias("w"), F.xxhash64("hk", "x.h").alias("lk"), F.col("x.doc").alias("doc"))


def _key(doc_id: str, text: str, host: str) -> Column:
    """A hash of a row; hashes pass over nulls, so these are told besides."""
    cs = [F.col(c) for c in (doc_id, host, text)]
    return F.xxhash64(*cs, *[c.isNull() for c in cs])


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, min_shared: int = MIN_SHARED, max_share: float = MAX_SHARE) -> DataFrame:
    """lk: the (host, line) above the limits."""
    docs = rows.select("lk", "hk", "doc").distinct().groupBy("lk", "hk").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min(min_shared, max_docs + 1))
    hosts = rows.select("hk", "doc").distinct().groupBy("hk").agg(F.count(F.lit(1)).alias("all_docs")).withColumn("jk", F.xxhash64("hk"))
    # joined on another hash besides: then both sides are exchanged for the join, and a hot host can be split
    both = docs.withColumn("jk", F.xxhash64("hk")).join(hosts, ["jk", "hk"])
    return both.where((F.col("docs") > max_docs) | (F.col("docs") >= min_shared) & (F.col("docs") > max_share * F.col("all_docs"))).select("lk")


def removed_lines(docs: DataFrame, text: str, host: str, key: Column, max_docs: int = MAX_DOCS) -> DataFrame:
    """key and ``gone``: array of (line number, words) of the lines above the limits; documents without any have no row."""
    rows = stored(_line_rows(docs, text, host, key), "lines")  # read thrice; a few dozen bytes a line
    often = frequent_lines(rows, max_docs).select("lk", F.xxhash64("lk").alias("jk"))  # likewise, for a hot line
    found = rows.select("k", "i", "w", "lk", F.xxhash64("lk").alias("jk")).join(often, ["lk", "jk"])
    return found.groupBy("k").agg(F.collect_set(F.struct("i", "w")).alias("gone"))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``lost_words``, ``kept`` and ``gone``, a row for each document; no texts are shuffled."""
    t = F.col(text)
    key = _key(doc_id, text, host)
    base = docs.select(
        F.col(doc_id).alias("doc_id"), key.alias("k"), base_counts(t).alias("c"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"),
    ).select("doc_id", "k", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    df = base.join(removed_lines(docs, text, host, key, max_docs), "k", "left")
    lost = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["w"]), F.lit(0).cast("long"))
    df = df.withColumn("lost_words", lost)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= MAX_LOST * F.col("n_words")))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """The kept documents, all columns, without the lines above the limit."""
    names = docs.columns
    key = _key(doc_id, text, host)
    # written, so that the condition isn't moved below the counts, which would then be made for it once more
    verdicts = stored(measure(docs, doc_id, text, host, max_docs).select("k", "kept", "gone"), "verdicts")
    verdicts = verdicts.where("kept").groupBy("k").agg(F.first("gone").alias("gone"))
    df = docs.select(F.struct(*names).alias("row"), key.alias("k")).join(verdicts, "k")
    gone = F.transform(F.coalesce("gone", F.array().cast("array<struct<i:int,w:bigint>>")), lambda x: x["i"])
    left = let(F.array_sort(gone), lambda g: F.array_join(F.filter(F.transform(lines(F.col(f"row.`{text}`")), lambda x, i: F.when(~F.array_contains(g, i), x)), lambda x: x.isNotNull()), "\n"))
    new = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(left)
    out = df.select("row", new.alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text else (F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)) for c in names])
