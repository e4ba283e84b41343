"""Jaccard join on word n-grams by signature trees, and the components of its links.

A document's set is its distinct 4-word shingles (64-bit hashes). Two sets A and B link when |A and B| / |A or B| >= 0.85.

1. Equal sets become one class (``sid``, a 64-bit hash of the sorted set).
2. Linked sets share one of their first n - ceil(0.85 n) + 1 shingles, in any order that is the same for all sets; classes meet under
   these as keys. Counted over all documents, the first shingles by hash show which are common (passages that many documents share);
   a fixed number of bits marks them, and in the order that is used then they come last. The order only decides how many meet,
   never what is found. Keys with the same members are
   taken once (members are compared by count and two 64-bit sums), a key is parted by bands of size, and keys with a smallest
   member in common are put together in a cell.
3. The members of a cell form a signature tree: sorted by size, leaves of ``LEAF`` sets, ``FANOUT`` nodes to a parent, each node with
   the OR of its sets' bitmaps, their range of sizes and their most bits lost by collision. A dual traversal prunes node pairs by
   the largest overlap they could have; pairs of sets that remain are compared exactly unless links found before connect them,
   so a cell gives at most one link less than it has members.
4. A cell with more than ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles is dealt out in blocks. First each block is joined within itself, with
   ``PIVOTS`` members of the cell beside it: near copies find one another through the pivots, in rows that grow with the members. What then is not of the
   cell's largest component meets the other blocks: the exact way for the rest, few where the cell is a group of near copies.
5. Components of the links by alternating large-star and small-star steps on distributed tables, each written to the shared folder.

Texts are found by a hash of row, once for each class, so null and repeated ids cost what other rows cost. Nothing that grows with the
corpus is broadcast or collected: only the ``CELLS`` bits of common shingles reach the driver.

Defined results: null texts and texts without words have no shingles and no links; a null id takes part, but names a component only
where no other id can; repeated rows are equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import stored

SHINGLE = 4
PERCENT = 85
#: a first shingle of more documents than this is common
COMMON = 8
CELLS = 1 << 24
_CHUNK = 1 << 14
LEAF = 32
FANOUT = 8
BLOCK = 160
BLOCK_SHINGLES = 1 << 21
PIVOTS = 4
#: blocks are larger where the rest of a cell meets them
REST = 2048

#: bytes hashed at a time
_PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# Values of the bytes, A-Z as a-z, for a polynomial in an odd base modulo 2^64, and the bytes that part words.
_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    base = 0xD1342543DE82EF95
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", cls.base), ("down", pow(cls.base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up[:n], cls.down[:n]


def word_hashes(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b: bytes of texts that begin at ``starts``; hashes of their words and where each begins."""
    n = len(b)
    blank = _BLANK[b]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[0] = after[-1] = True
    inner = starts[(starts > 0) & (starts < n)]
    before[inner] = after[inner - 1] = True
    first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after)
    up, down = _Powers.of(n)
    v = _VALUE[b] * up
    c = np.cumsum(v)
    return _mixed((c[last] - c[first] + v[first]) * down[first] + (last - first + 1).astype(np.uint64) * np.uint64(_ODD)), first


def _long_text(b: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, cut between words."""
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _PIECE)
        while end < len(b) and not _BLANK[b[end]]:
            end += 1
        out.append(word_hashes(b[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def words_of(column) -> Iterator[np.ndarray]:
    """Hashes of the words of each text of an Arrow column; null texts have none."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    if column.null_count:  # a null may have bytes
        keep = column.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(column):
        j = i + 1
        while j < len(column) and ends[j + 1] - ends[i] <= _PIECE:
            j += 1
        b = data[ends[i] : ends[j]]
        if j == i + 1 and len(b) > _PIECE:
            found = [_long_text(b)]
        elif not len(b):
            found = [np.empty(0, np.uint64)] * (j - i)
        else:
            h, first = word_hashes(b, ends[i:j] - ends[i])
            found = np.split(h, np.searchsorted(first, ends[i + 1 : j] - ends[i]))
        for k, h in enumerate(found, i):
            yield h if not column.null_count or keep[k] else h[:0]
        i = j


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a text's words, repeats included; with fewer words, the whole sequence as one."""
    n = len(w)
    if not n:
        return w
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h *= np.uint64(_ODD)
        h += w[i : n - k + 1 + i]
    return _mixed(h)


def shingle_sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for w in words_of(column):
        h = shingles(w)
        h.sort()
        yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


# --- common shingles


def common_bits(docs: DataFrame, doc_id: str, text: str, percent: int = PERCENT) -> bytes:
    """A bit for each of ``CELLS`` (the low bits of a hash): whether a common shingle falls there.

    Common are the first shingles of sets, by hash alone, that more than ``COMMON`` documents have among theirs; the limit is doubled
    until no more than a quarter of the bits can be set.
    """
    first = described(docs, doc_id, text, None, percent).select(F.explode("keys").alias("key"))
    often = stored(first.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > COMMON), "common")
    steps = {r.step: r.n for r in often.groupBy(F.floor(F.log2(F.col("m"))).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each power of two
    limit = COMMON
    while sum(n for k, n in steps.items() if 2 ** (k + 1) > limit) > CELLS // 4:
        limit *= 2
    cell = F.col("key").bitwiseAND(F.lit(CELLS - 1))
    chunks = often.where(F.col("m") > limit).groupBy(F.floor(cell / _CHUNK).cast("int").alias("chunk")).agg(F.collect_set((cell % _CHUNK).cast("int")).alias("at"))

    def bits(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for at in batch.column(1).to_pylist():
                b = np.zeros(_CHUNK, bool)
                b[at] = True
                out.append(np.packbits(b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "bits"])

    found = {r.chunk: bytes(r.bits) for r in chunks.mapInArrow(bits, "chunk int, bits binary").collect()}  # CELLS bits in all
    return b"".join(found.get(c, bytes(_CHUNK // 8)) for c in range(CELLS // _CHUNK))


# --- sets and keys


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def set_id(s: np.ndarray) -> int | None:
    import xxhash

    if not len(s):
        return None
    v = xxhash.xxh3_64_intdigest(s.tobytes())
    return v - (1 << 64) if v >> 63 else v


def _row_key(doc_id: str, text: str) -> Column:
    """A hash of id and text; hashes pass over nulls, so these are told besides."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())


def described(docs: DataFrame, doc_id: str, text: str, cells: bytes | None, percent: int = PERCENT) -> DataFrame:
    """doc_id, k (hash of id and text), n (size of the set), sid (null for an empty one), keys (its first shingles, the common ones last)."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), _row_key(doc_id, text).alias("k"))

    def run(batches):
        import pyarrow as pa

        common = None if cells is None else np.unpackbits(np.frombuffer(cells, np.uint8)).astype(bool)
        for batch in batches:
            ns, sids, keys, ends = [], [], [], [0]
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                first = n - -(-percent * n // 100) + 1 if n else 0
                rare = s
                if common is not None and n:
                    hot = common[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                    rare = s[~hot]
                    if len(rare) < first:
                        rare = np.concatenate([rare, s[hot][: first - len(rare)]])
                keys.append(_as_long(np.ascontiguousarray(rare[:first])))
                ends.append(ends[-1] + len(keys[-1]))
                ns.append(n)
                sids.append(set_id(s))
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), arrays], names=["doc_id", "k", "n", "sid", "keys"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, k long, n long, sid long, keys array<long>")


# --- signature trees


class SignatureTree:
    """Sets in the order of their sizes, with their bitmaps and the nodes above them, level by level."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        marks = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(sets):
            marks[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        self.bits = np.packbits(marks, axis=1).view(np.uint64)
        self.lost = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        # levels[0]: the leaves; a node is (first set, last set + 1, OR, least size, greatest size, most lost)
        starts = np.arange(0, len(sets), LEAF)
        level = [(s, e, np.bitwise_or.reduce(self.bits[s:e]), self.sizes[s], self.sizes[e - 1], self.lost[s:e].max()) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(sets)], strict=True)]
        self.levels = [level]
        while len(level) > 1:
            groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
            level = [(g[0][0], g[-1][1], np.bitwise_or.reduce([x[2] for x in g]), g[0][3], g[-1][4], max(x[5] for x in g)) for g in groups]
            self.levels.append(level)


def _may_link(p, q, percent: int) -> bool:
    """Whether a set of node p and a set of node q can overlap enough, by their sizes and bitmaps."""
    if 100 * p[4] < percent * q[3] or 100 * q[4] < percent * p[3]:
        return False
    most = min(int(np.bitwise_count(p[2] & q[2]).sum()) + min(p[5], q[5]), p[4], q[4])
    return (100 + percent) * most >= percent * (p[3] + q[3])


def near_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of the pairs of sets (of one tree: each once) that sizes and bitmaps don't rule out."""
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        p, q = a.levels[la][i], b.levels[lb][j]
        if not (same and la == lb and i == j) and not _may_link(p, q, percent):
            continue
        if la == lb == 0:
            need = percent * (a.sizes[p[0] : p[1], None] + b.sizes[None, q[0] : q[1]])
            most = np.bitwise_count(a.bits[p[0] : p[1], None] & b.bits[None, q[0] : q[1]]).sum(axis=2).astype(np.int64) + np.minimum(a.lost[p[0] : p[1], None], b.lost[None, q[0] : q[1]])
            most = np.minimum(most, np.minimum(a.sizes[p[0] : p[1], None], b.sizes[None, q[0] : q[1]]))
            x, y = np.nonzero((100 + percent) * most >= need)
            x, y = x + p[0], y + q[0]
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        below = lambda level, k: range(k * FANOUT, min((k + 1) * FANOUT, len(level)))
        if same and la == lb and i == j:
            kids = list(below(a.levels[la - 1], i))
            stack += [(la - 1, k, lb - 1, m) for k in kids for m in kids if k <= m]
        elif la >= lb:
            stack += [(la - 1, k, lb, j) for k in below(a.levels[la - 1], i)]
        else:
            stack += [(la, i, lb - 1, k) for k in below(b.levels[lb - 1], j)]


def links(sids: list[int], sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all linked sets, a forest. side: 0 for sets known to be connected, 1 for others; only pairs of both sides are then looked at."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sids[i]))
    parent = list(range(len(sets)))
    if side is not None and 0 in side:
        parent = [i if s else side.index(0) for i, s in enumerate(side)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    middle = len(sets[order[len(order) // 2]])
    bits = 1 << min(13, max(8, (2 * middle - 1).bit_length()))
    groups = [order] if side is None else [[i for i in order if side[i] == s] for s in (0, 1)]
    if not all(groups):
        return []
    trees = [SignatureTree([sets[i] for i in g], bits) for g in groups]
    out = []
    for xs, ys in near_pairs(trees[0], trees[-1], percent):
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            i, j = groups[0][x], groups[-1][y]
            ri, rj = root(i), root(j)
            if ri == rj:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * shared >= percent * (len(both) - shared):
                parent[max(ri, rj)] = min(ri, rj)
                out.append((sids[i], sids[j]))
    return out


def _cell_links(df: DataFrame, percent: int) -> DataFrame:
    """df: cell, blk, side, sid, t (text); links (a, b) that connect the linked sets of each (cell, blk), between its two sides if ``side`` isn't null."""

    def run(batches):
        import pyarrow as pa

        now, sids, sets, side = None, [], [], []

        def done():
            found = links(sids, sets, None if side[0] is None else side, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cell, blk, sd, sid = (batch.column(k).to_pylist() for k in range(4))
            for r, s in enumerate(shingle_sets(batch.column(4))):
                if (at := (cell[r], blk[r])) != now:
                    if len(sids) > 1:
                        yield done()
                    now, sids, sets, side = at, [], [], []
                if set_id(s) == sid[r] and sid[r] not in sids[-1:]:  # another text under the same hash of row; a pivot in its own block
                    sids.append(sid[r])
                    sets.append(s)
                    side.append(sd[r])
        if len(sids) > 1:
            yield done()

    rows = df.select("cell", "blk", "side", "sid", "t").repartition("cell", "blk").sortWithinPartitions("cell", "blk", "sid")
    return rows.mapInArrow(run, "a long, b long")


def _cells(desc: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cell, sid, n: classes that stand under a key together, as a table; the cells of one member are left out."""
    pairs = classes.select(F.explode("keys").alias("key"), "sid").repartition("key")  # dealt once, used by both the counts and the join
    met = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("m > 1")
    kept = met.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = pairs.join(kept, "key").join(classes.select("sid", "n"), "sid")
    # sizes of linked sets lie in one band or in neighbours: a set stands under its own band and the next
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    banded = stored(members.select("key", "sid", "n", F.explode(F.array(band, band + 1)).alias("band")), "members")
    # keys with a smallest member in common become one cell, so that a text is sent to few of them
    meets = banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m"), F.min("sid").alias("cell")).where("m > 1").select("key", "band", "cell", F.xxhash64("key", "band").alias("jk"))
    return stored(banded.withColumn("jk", F.xxhash64("key", "band")).join(meets, ["jk", "key", "band"]).select("cell", "sid", "n").distinct(), "placed")


def set_links(docs: DataFrame, desc: DataFrame, doc_id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """a, b: links between classes that connect all that are linked. desc: ``described``, as a table."""
    classes = stored(desc.where("sid IS NOT NULL").groupBy("sid").agg(F.first("keys").alias("keys"), F.first("n").alias("n"), F.min("k").alias("rep")), "classes")
    placed = _cells(desc, classes, percent)
    # each text once, however often a row is repeated
    texts = docs.select(_row_key(doc_id, text).alias("rep"), F.col(text).alias("t")).groupBy("rep").agg(F.first("t").alias("t"))

    def with_texts(cells: DataFrame) -> DataFrame:
        return texts.join(cells.join(classes.select("sid", "rep"), "sid"), "rep")

    by_cell = F.xxhash64("cell")  # joined on another hash besides, so that both sides are exchanged and a large cell can be split
    pick = lambda i: F.min(F.struct(F.xxhash64("sid", F.lit(i)), "sid"))["sid"]
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), *[pick(i).alias(f"p{i}") for i in range(PIVOTS)])
    blocks = lambda most, factor: F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("all") / (factor * BLOCK_SHINGLES))).cast("int")
    sizes = stored(sizes.select("cell", blocks(BLOCK, 1).alias("g"), blocks(REST, 4).alias("g2"), F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots")), "cells")
    blk = lambda g: F.pmod(F.xxhash64("sid", F.lit(2)), g).cast("int")
    dealt = placed.select("cell", "sid").withColumn("jk", by_cell).join(sizes.select("cell", "g", "g2").withColumn("jk", by_cell), ["jk", "cell"])
    own = dealt.select("cell", blk("g").alias("blk"), "sid")
    beside = sizes.where("g > 1").select("cell", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("blk"), "pivots").select("cell", "blk", F.explode("pivots").alias("sid"))
    none = F.lit(None).cast("int").alias("side")
    first = stored(_cell_links(with_texts(own.union(beside)).select("cell", "blk", none, "sid", "t"), percent), "near")
    large = dealt.where("g > 1")
    if not large.head(1):
        return first
    # of each large cell, the members that aren't of its largest component meet the blocks of all others
    roots = stored(components(first).select(F.col("v").alias("sid"), "root"), "roots")
    held = stored(large.select("cell", "g2", "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "held")
    counts = held.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cell").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("c"))
    counts = counts.where("c < m").select("cell", "main").withColumn("jk", by_cell)
    both = stored(held.withColumn("jk", by_cell).join(counts, ["jk", "cell"]).select("cell", "g2", "sid", (F.col("root") == F.col("main")).alias("in_main")), "rest")
    if not both.head(1):
        return first
    main = both.where("in_main").select("cell", blk("g2").alias("blk"), F.lit(0).alias("side"), "sid")
    rest = both.where("not in_main")
    meet = rest.select("cell", F.explode(F.sequence(F.lit(0), F.col("g2") - 1)).alias("blk"), F.lit(1).alias("side"), "sid")
    # the rest among itself: pairs of its own blocks, numbered below zero
    n_rest = rest.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / REST).cast("int").alias("g3")).withColumn("jk", by_cell)
    among = rest.withColumn("jk", by_cell).join(n_rest, ["jk", "cell"]).withColumn("b", F.pmod(F.xxhash64("sid", F.lit(3)), "g3").cast("int"))
    among = among.select("cell", "sid", "b", "g3", F.explode(F.sequence(F.lit(0), F.col("g3") - 1)).alias("o"))
    pair = -1 - F.least("b", "o") * F.col("g3") - F.greatest("b", "o")
    among = among.select("cell", pair.cast("int").alias("blk"), none, "sid")
    return first.union(_cell_links(with_texts(main.union(meet).union(among)), percent))


# --- components


def components(edges: DataFrame) -> DataFrame:
    """v, root (the smallest of its component) for every v of the edges (a, b) but the roots themselves."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).collect()[0]
        return tuple(r)

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")  # u > v
    was = None
    while (now := state(e)) != was:
        was = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _rooted(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """sid, doc_id, k, n and root (null for an empty set) of every document, as a table."""
    desc = stored(described(docs, doc_id, text, common_bits(docs, doc_id, text, percent), percent), "described")
    roots = components(set_links(docs, desc, doc_id, text, percent))
    own = desc.select("doc_id", "k", "n", "sid")
    df = own.join(roots.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return stored(df, "rooted")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and sid of every document."""
    df = _rooted(docs, doc_id, text, percent)
    # a table of a row per component, joined on another hash besides so that both sides are exchanged and a large one is split
    least = df.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("jk", F.xxhash64("root"))
    out = df.withColumn("jk", F.xxhash64("root")).join(least, ["jk", "root"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sid")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, of which each component keeps one row: of the smallest id, null as the last, then by the other columns.

    Empty sets are components by their id; those without an id, by their text.
    """
    df = _rooted(docs, doc_id, text, percent)
    place = F.struct(F.col("doc_id").isNull().alias("nil"), F.col("doc_id").alias("id"), "k")
    linked = df.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("p")).select("p.k")
    empty = df.where("root IS NULL").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("k")).alias("own")).agg(F.min("k").alias("k")).select("k")
    stay = linked.union(empty).withColumnRenamed("k", "__k")
    rest = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in (doc_id, text) and "map<" not in kind and kind != "variant"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_key(doc_id, text).alias("__k")).join(stay, "__k")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*rest or [F.lit(0)]))).where("__n = 1")
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
