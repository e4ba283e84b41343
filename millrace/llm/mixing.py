"""Mixing sources to target weights with a curriculum that changes over the training run.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the words of all documents; a target stops
at ``MAX_EPOCHS`` times its source's size and the excess is shared again by weight (water filling: target = min(cap, level *
weight); the level is found over the sources sorted by cap / weight).

Taking: a source's documents are ordered by a hash of id and text; every document is taken ``floor(target / size of source)``
times, and the first ones in that order once more until the target is met, the last of them cut.

Curriculum: source ``s`` of weight ``w`` is asked for at the rate ``target * (1 + slope * (2 t - 1))`` for t from 0 to 1, with
a slope from its place among the sources; the integral over t is the target. A copy that begins after ``c`` words of its
source gets the t at which the integral reaches ``c``, and the position in the run is the integral over all sources up to
that t; documents are range-sorted by position.

Scale: prefix sums are taken in two levels, (source, bucket of the hash) and then buckets of a source, so no window holds a
source; buckets hold about ``BUCKET_ROWS`` documents, whatever their ids (equal or null ids lie in as many buckets as they have
texts). Tables of a row per source are joined by equality and never collected; their targets are found in one task.

Defined results: null text has size 0; null source is a source of its own; documents of size 0 are never taken (taken 0, no
position, last in the order); repeated rows are taken each on its own, one after the other; rows of one id with unlike texts are
ordered by the texts' hashes, so reruns agree; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import SPACE, n_words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 2000
SLOPES = (-0.8, 0.0, 0.8)


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target and slope; a row per source."""
    one = Window.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col("place") % len(xs) + 1).cast("int"))
    df = sizes.withColumn("place", place).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES)).withColumn("cap", F.col("source_size") * float(cap))
    # before a source in the order of cap / weight, all earlier ones are at their cap
    order = one.orderBy((F.col("cap") / F.col("weight")), F.col("place"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(one).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", rest / weight)
    df = df.withColumn("rank", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(one)["level"]
    df = df.withColumn("target", F.round(F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap"))), 6))
    df = df.withColumn("all_targets", F.sum("target").over(one)).withColumn("all_slopes", F.sum(F.col("target") * F.col("slope")).over(one))
    return df.select("source", "source_size", "place", "weight", "slope", "target", "all_targets", "all_slopes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: float = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS, carry: bool = True) -> DataFrame:
    """A row per document: ``row`` (its columns, with ``carry``), doc_id, source, size, source_size, target, taken, begins (array of
    words of the source before each of its copies), positions (array, a place in the run for each copy)."""
    names = docs.columns
    size = n_words(F.col(text))
    df = docs.select(*([F.struct(*names).alias("row")] if carry else []), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _hash(F.col(doc_id), F.col(text)).alias("h"))
    # the number of buckets grows with the table; the order of documents doesn't depend on it
    n = docs.count()
    buckets = 1 << max(0, (max(1, n) // bucket_rows).bit_length())
    df = df.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))  # in the order of h
    # null is a source: grouping keeps it, joining by a text that no other source has
    tag = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    df = df.withColumn("tag", tag)
    by_bucket = df.groupBy("tag", "source", "bucket").agg(F.sum("size").alias("words"))
    by_source = targets(by_bucket.groupBy("tag", "source").agg(F.sum("words").alias("source_size")).drop("tag"), weights, cap).withColumn("tag", tag).drop("source")
    within = Window.partitionBy("tag").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0))).select("tag", "bucket", "before").join(by_source, "tag")
    df = df.join(offsets, ["tag", "bucket"])
    inside = Window.partitionBy("tag", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    df = df.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("at")))
    df = df.withColumn("more", more).withColumn("taken", F.col("epochs") * F.col("size") + F.col("more"))
    copies = F.when(F.col("taken") > 0, F.col("epochs") + (F.col("more") > 0).cast("long")).otherwise(0).cast("int")
    begins = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), lambda e: e.cast("long") * F.col("source_size") + F.col("at"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("begins", begins)
    positions = F.transform("begins", lambda c: _position(_time(c / F.col("target"), F.col("slope")), F.col("all_targets"), F.col("all_slopes")))
    keep = (["row"] if carry else []) + ["doc_id", "source", "size", "source_size", "target", "taken", "begins"]
    return df.select(*keep, positions.alias("positions"))


def _hash(doc_id: Column, text: Column) -> Column:
    """What orders the documents of a source, as hex digits."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The curriculum, range-sorted by position: a row per document with doc_id, source, size, source_size, target, taken, copies, the words of its
    source before its first copy (``begins``), the positions of its first and last copy in the run; documents never taken come last."""
    df = mix(docs, doc_id, text, source, carry=False, **more)
    at = lambda i: F.try_element_at("positions", F.lit(i))
    df = df.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), F.try_element_at("begins", F.lit(1)).alias("begins"), at(1).alias("position"), at(-1).alias("last_position"))
    return df.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "size")


def _time(share: Column, slope: Column) -> Column:
    """The t at which (1 - slope) t + slope t^2 = share."""
    b = 1.0 - slope
    root = (F.sqrt(F.greatest(F.lit(0.0), b * b + 4.0 * slope * share)) - b) / (2.0 * slope)
    return F.when(slope == 0, share).otherwise(root)


def _position(t: Column, all_targets: Column, all_slopes: Column) -> Column:
    """Words asked for by all sources up to t: sum of target * ((1 - slope) t + slope t^2)."""
    return (all_targets - all_slopes) * t + all_slopes * t * t


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: documents as often as they are taken, the cut ones cut, range-sorted by position; the columns of ``docs``."""
    names = docs.columns
    df = mix(docs, doc_id, text, source)
    df = df.select("row", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    t = F.col(f"row.`{text}`")
    cut = F.concat(F.regexp_extract(t, rf"\A{SPACE}*", 0), F.array_join(F.slice(F.split(F.regexp_replace(t, rf"\A{SPACE}+", ""), f"{SPACE}+"), F.lit(1), left.cast("int")), " "))
    df = df.withColumn("new", F.when(left == F.col("size"), t).otherwise(cut))
    types = {f.name: f.dataType for f in docs.schema}
    out = [F.col("new").alias(c) if c == text else (F.when(left == F.col("size"), F.col("row.n_chars")).otherwise(F.length("new")).cast(types[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)) for c in names]
    return df.orderBy("position", F.col("row")[doc_id], "copy").select(*out)
