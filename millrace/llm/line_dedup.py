"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last ``WINDOW`` lines with words puts a boundary after a line where it is 0 modulo ``SPACING``
and was not one line before, so boundaries stand two lines apart at least, depend on nearby lines only and move with them when
lines are inserted above. Chunks of two lines or more that occur again, in the corpus or in one text, are removed but for the first
occurrence, by document id. As a passage may end between two boundaries, or hold none, the rolling windows themselves are the finest
chunks: windows that occur again and follow one another make a stretch, and one of ``LONG`` words or more is removed as well, up to
the lines where texts part. A line of ``LONG`` words or more is a window by itself. Whatever is removed stays where it stood first.

Steps: (1) hashes of chunks and windows are counted, pre-aggregated, no texts shuffled, and each document's list of the repeated ones is
written to the shared folder; (2) byte comparison: the lines of removed stretches are grouped by their hash, and their least and
greatest text must be equal, else the lines of that hash stay; a line goes once from each task that holds it, so a hot passage costs
no more than others; (3) documents meet their lists and lose the lines. Texts are shuffled in (3) and their repeated lines in (2).

Defined results: null and empty texts have no chunks and stay; a null id counts as the last; repeated rows (same id
and text) are one document and are treated alike; lines without words are in no chunk, and go where the line before them goes; documents
that lose all their words are dropped by ``dedup``; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import NOT_SPACE, SPACE, let, n_words, prefix_sums
from millrace.tables import stored

WINDOW = 2
SPACING = 3
LONG = 50
_PRIME = 2_147_483_647
_FACTOR = 1_000_003 % 1000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(x: Column) -> Column:
    """60 bits, which SQL has too."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def chunks(text: Column, spacing: int = SPACING, long: int = LONG) -> Column:
    """Array of (kind, first, size, h1, h2), first and size in lines with words; kind 1: chunks of two lines or more, 2: windows, 3: long lines."""

    def of(ls: Column) -> Column:
        """ls: lines with words, as (h, g, long)."""
        n = F.size(ls)
        get = lambda i, f: F.get(ls, i)[f]
        # whether the rolling hash is 0 after each line
        zeros = F.transform(ls, lambda x, i: F.when(i > 0, (x["h"] % _PRIME + get(i - 1, "h") % _PRIME * _FACTOR) % _PRIME % spacing == 0).otherwise(False))
        ends = lambda z: F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | F.get(z, i) & ~F.get(z, i - 1))
        one = lambda kind, first, size, h1, h2: F.struct(F.lit(kind).alias("kind"), first.alias("first"), size.alias("size"), h1.alias("h1"), h2.alias("h2"))
        both = lambda s, f: F.transform(s, lambda x: x[f])

        def chunk(first: Column, end: Column) -> Column:
            return let(F.slice(ls, first + 1, end - first + 1), lambda s: one(1, first, end - first + 1, F.xxhash64(both(s, "h")), F.xxhash64(both(s, "g"))))

        cut = lambda e: F.filter(F.transform(e, lambda end, k: F.struct(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0).alias("first"), end.alias("end"))), lambda c: c["end"] > c["first"])
        large = F.transform(let(let(zeros, ends), cut), lambda c: chunk(c["first"], c["end"]))
        windows = F.transform(F.slice(ls, F.lit(1), n - 1), lambda x, i: one(2, i, F.lit(2), F.xxhash64(x["h"], get(i + 1, "h")), F.xxhash64(x["g"], get(i + 1, "g"))))
        longs = F.filter(F.transform(ls, lambda x, i: F.when(x["long"], one(3, i, F.lit(1), x["h"], x["g"]))), lambda c: c.isNotNull())
        kind = "array<struct<kind:int,first:int,size:int,h1:bigint,h2:bigint>>"
        return F.when(n > 1, F.concat(large.cast(kind), windows.cast(kind), longs.cast(kind))).otherwise(longs.cast(kind))

    hashed = F.transform(F.filter(lines(text), lambda x: x.rlike(NOT_SPACE)), lambda x: F.struct(line_hash(x).alias("h"), F.xxhash64(x).alias("g"), _is_long(x, long).alias("long")))
    return F.when(F.length(text) > 0, let(hashed, lambda ls: F.when(F.size(ls) > 0, of(ls))))


def _is_long(x: Column, long: int) -> Column:
    """Whether a line has ``long`` words, read no further than to the last of them."""
    return F.when(F.length(x) >= 2 * long - 1, x.rlike(rf"\A{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{long - 1}}}{NOT_SPACE}")).otherwise(False)


def _key(doc_id: str, text: str) -> Column:
    """A hash of a row; hashes pass over nulls, so these are told besides."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())


def _candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k and ``cand``: array of a document's repeated chunks (kind, first, size, original: whether it is the first occurrence); no texts."""
    own = docs.select(_key(doc_id, text).alias("k"), F.col(doc_id).alias("id"), F.explode(chunks(F.col(text))).alias("c"))
    place = F.struct(F.col("id").isNull().alias("nil"), F.col("id").alias("id"), F.col("k"), F.col("c.first").alias("first"))
    each = stored(own.select("k", place.alias("place"), "c.kind", "c.size", "c.h1", "c.h2"), "chunks")  # hashes only; read twice
    more = each.groupBy("kind", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("original")).where("n > 1")
    jk = F.xxhash64("h1", "h2", F.lit(1))  # joined on another hash besides, so that both sides are exchanged for it
    found = each.withColumn("jk", jk).join(more.drop("n").withColumn("jk", jk), ["jk", "kind", "h1", "h2"])
    return found.groupBy("k").agg(F.collect_set(F.struct("kind", F.col("place.first").alias("first"), "size", (F.col("place") == F.col("original")).alias("original"))).alias("cand"))


def _filled(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(NOT_SPACE))


def _inside(cand: Column, *kinds: int) -> Column:
    """Sorted distinct lines of the chunks of these kinds."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(cand, lambda c: c["kind"].isin(*kinds)), lambda c: F.sequence(c["first"], c["first"] + c["size"] - 1)))))


def _stretches(starts: Column, ls: Column, long: int) -> Column:
    """Lines of the stretches of ``long`` words or more; starts: sorted first lines of windows, ls: lines with words."""
    begins = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda p: F.when(p > 0, F.get(starts, p) - F.get(starts, p - 1) > 1).otherwise(True))
    spans = lambda b: F.transform(b, lambda p, k: F.struct(F.get(starts, p).alias("a"), (F.get(starts, F.coalesce(F.get(b, k + 1), F.size(starts)) - 1) + 1).alias("z")))
    sums = prefix_sums(F.transform(ls, lambda x: n_words(x).cast("long")))
    good = lambda w: F.filter(let(begins, spans), lambda s: F.get(w, s["z"]) - F.when(s["a"] > 0, F.get(w, s["a"] - 1)).otherwise(0) >= long)
    return F.flatten(F.transform(let(sums, good), lambda s: F.sequence(s["a"], s["z"])))


def _gone(cand: Column, text: Column, long: int = LONG) -> Column:
    """Numbers, among the lines with words, of those that repeat: in chunks, or in stretches of windows of ``long`` words or more."""
    more = F.filter(cand, lambda c: ~c["original"])
    starts = let(more, lambda m: F.array_sort(F.array_distinct(F.transform(F.filter(m, lambda c: c["kind"] == 2), lambda c: c["first"]))))
    far = let(starts, lambda s: F.when(F.size(s) > 0, let(_filled(text), lambda ls: _stretches(s, ls, long))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_union(_inside(more, 1, 3), far))


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines ``gone`` (numbers among those with words) and the lines without words that follow them."""

    def of(ls: Column, at: Column) -> Column:
        """at: places of the lines with words."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), gone)
        parts = F.transform(kept, lambda j: F.slice(ls, F.get(at, j) + 1, F.coalesce(F.get(at, j + 1), F.size(ls)) - F.get(at, j)))
        return F.array_join(F.concat(F.slice(ls, F.lit(1), F.get(at, F.lit(0))), F.flatten(parts)), "\n")

    places = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(NOT_SPACE), i)), lambda i: i.isNotNull())
    return let(lines(text), lambda ls: let(places(ls), lambda at: of(ls, at)))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, ``gone`` (numbers, among the lines with words, of the lines to remove) and ``left``, the text without them."""
    key = _key(doc_id, text)
    cand = stored(_candidates(docs, doc_id, text), "repeated")
    # byte comparison: the lines of one hash are one text, or stay
    held = lambda c, t: let(_filled(t), lambda ls: F.transform(_inside(c, 1, 2, 3), lambda i: F.struct(i.alias("i"), line_hash(F.get(ls, i)).alias("h"), F.xxhash64(F.get(ls, i)).alias("g"), F.get(ls, i).alias("x"))))
    each = docs.select(key.alias("k"), F.col(text).alias("t")).join(cand, "k").select("k", F.explode(held(F.col("cand"), F.col("t"))).alias("e")).select("k", "e.*")
    unlike = stored(each.groupBy("h", "g").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a <> z").select("h", "g"), "unlike")  # as good as empty
    df = docs.select(F.struct(*docs.columns).alias("row"), key.alias("k")).join(cand, "k", "left")
    t = F.col(f"row.`{text}`")
    none = F.array().cast("array<int>")
    gone = F.when(F.col("cand").isNotNull(), _gone(F.col("cand"), t)).otherwise(none)
    if unlike.head(1):
        stay = stored(each.join(unlike, ["h", "g"]).groupBy("k").agg(F.collect_set("i").alias("stay")), "stay")
        df, gone = df.join(stay, "k", "left"), F.array_except(gone, F.coalesce("stay", none))
    df = df.select("row", gone.alias("gone"))
    return df.withColumn("left", F.when(F.size("gone") > 0, _without(t, F.col("gone"))).otherwise(t))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without repeated chunks, all columns; those that lose all their words are dropped."""
    df = mark(docs, doc_id, text).where((F.size("gone") == 0) | F.col("left").rlike(NOT_SPACE))
    types = {f.name: f.dataType for f in docs.schema}
    new = lambda c: F.col("left") if c == text else (F.when(F.size("gone") == 0, F.col("row.n_chars")).otherwise(F.length("left")).cast(types[c]) if c == "n_chars" else F.col(f"row.`{c}`"))
    return df.select(*[new(c).alias(c) for c in docs.columns])
