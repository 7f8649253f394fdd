"""N-gram Jaccard join by an R-tree over count vectors.

A document's set of word n-grams is a point: its n-grams are hashed into groups and counted per group. Two sets share at
most the sum over groups of the smaller count, and two boxes of points at most the sum of the smaller upper corners.

1. Equal word sequences (A-Z lower-cased) are one point, told by a BLAKE2b digest of the words.
2. Points are packed into leaves by size band and by the point's first coordinate in hash order that other documents
   have as well, so near copies lie together. A leaf is bounded in points and bytes.
3. Boxes of thousands of random points overlap in every group, so a tree alone would compare nearly all pairs of leaves.
   Which points of two leaves are compared is therefore settled by coordinates, without loss: n-grams are ordered from
   rare to common by the levels of a merged count-min sketch, and two sets that reach the threshold share one of the first
   n - ceil(t * n) + 1 of each; those of level 1 no other document has. The points of leaves A and B that share such a
   coordinate across A and B form the task (A, B); no closure over pairs is taken.
4. A task packs its points into a tree of boxes by coordinates (NODE points, then NODE boxes each) and descends through
   pairs of boxes whose summed minima can reach the threshold, then pairs of points; what survives is verified on the
   words: n-grams get exact numbers within the task, from a table of its words, in place of hashes.

Each pair of points meets in one task at most, so links are counted exactly.
"""

from __future__ import annotations

import hashlib
from math import ceil, floor, log, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_counted, slices, staged, windows_of, words_of
from palimpsest.llm.components import connected_components, forest
from palimpsest.llm.exact_dedup import hit_filter
from palimpsest.llm.repeat_sketch import PARTIAL, in_blocks, levels_of, merged_replies, partial_sketch

#: Fewest and most groups of the count vector; most points and bytes of words of a leaf, about; points or boxes in a box.
GROUPS, MOST_GROUPS, LEAF_POINTS, LEAF_BYTES, NODE = 64, 1024, 1024, 4 << 20, 16
#: N-grams of this level (the highest) may be in any number of documents; their meetings are dealt by leaf.
HOT = 255
#: Ratio between the sizes of neighbouring bands.
BAND = 1.2
#: A leaf's number has its band above so many bits.
BAND_BITS = 52


def shingle_sets(column, n: int):
    """Per text of an Arrow column: (row, sorted distinct 64-bit hashes of its word n-grams), A-Z lower-cased.

    With fewer than n words the whole sequence is one; without words the set is empty."""
    for first, end, data, ends in slices(column):
        _, _, text, (word,) = words_of(data, ends, lower=True)
        at, (h,) = windows_of(text, [word], n)
        owner = text[at]
        count = np.bincount(text, minlength=end - first)
        stops = np.searchsorted(owner, np.arange(end - first + 1))
        begin = np.cumsum(count) - count
        for i in range(end - first):
            if count[i] >= n:
                yield first + i, np.unique(h[stops[i] : stops[i + 1]])
            elif count[i]:
                own = word[begin[i] : begin[i] + count[i]]
                yield first + i, windows_of(np.zeros(len(own), np.int64), [own], len(own))[1][0]
            else:
                yield first + i, np.zeros(0, np.uint64)


def plain_words(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, joined by one space."""
    return b" ".join((text or "").encode().lower().split())


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct word n-grams of each text (words joined by one space) as numbers, equal where the n-grams are."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number) + 1) for w in t.split(b" ")] for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    grams = np.maximum(size - n + 1, 1)
    flat = np.concatenate([*map(np.array, words), np.zeros(n, np.int64)]).astype(np.int64)
    first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), grams)
    at = first[owner] + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    code = flat[at]
    for j in range(1, n):  # pairs of numbers are numbered anew; 0 stands for no word
        code = np.unique(code * (len(number) + 1) + np.where(j < size[owner], flat[at + j], 0), return_inverse=True)[1]
    return [np.unique(c) for c in np.split(code, np.cumsum(grams)[:-1])]


def reaches(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union."""
    return 100 * shared >= percent * (a + b - shared)


class Tree:
    """Points packed by their coordinates into boxes of NODE points, and those into boxes of NODE boxes."""

    def __init__(self, n: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        spread = vectors[points].var(0)
        axes = np.argsort(-spread, kind="stable")[:3]
        order = np.lexsort((*(vectors[points][:, a] for a in axes), n[points]))
        self.n, self.vectors = n, vectors
        self.parts = [points[order[i : i + NODE]] for i in range(0, len(points), NODE)]
        self.corner = np.array([vectors[p].max(0) for p in self.parts])
        self.low, self.high = (np.array([f(n[p]) for p in self.parts]) for f in (np.min, np.max))
        cuts = np.arange(0, len(self.parts), NODE)
        self.upper = [np.arange(c, min(c + NODE, len(self.parts))) for c in cuts]
        self.upper_corner = np.maximum.reduceat(self.corner, cuts)
        self.upper_low, self.upper_high = np.minimum.reduceat(self.low, cuts), np.maximum.reduceat(self.high, cuts)

    @staticmethod
    def _near(corner, low, high, corners, lows, highs, percent):
        most = np.minimum(np.minimum(corner, corners).sum(1), np.minimum(high, highs))  # most that any pair of points shares
        return np.flatnonzero(reaches(most, low, lows, percent))

    def meet(self, other: Tree, percent: int):
        """Pairs of points (one here, one of ``other``) that summed minima leave; within one tree each pair once."""
        same = self is other
        for u in range(len(self.upper)):
            tops = self._near(self.upper_corner[u], self.upper_low[u], self.upper_high[u], other.upper_corner, other.upper_low, other.upper_high, percent)
            tops = tops[tops >= u] if same else tops
            if not len(tops):
                continue
            below = np.concatenate([other.upper[t] for t in tops])
            for i in self.upper[u]:
                some = below[below >= i] if same else below
                some = some[self._near(self.corner[i], self.low[i], self.high[i], other.corner[some], other.low[some], other.high[some], percent)]
                step = max(1, (1 << 22) // (NODE * NODE * self.vectors.shape[1]))
                for a in range(0, len(some), step):
                    yield self._points(i, some[a : a + step], other, percent)

    def _points(self, i: int, some: np.ndarray, other: Tree, percent: int):
        part, others = self.parts[i], np.concatenate([other.parts[j] for j in some])
        most = np.minimum(self.vectors[part][:, None, :], other.vectors[others][None]).sum(2)
        x, y = np.nonzero(reaches(most, self.n[part][:, None], self.n[others][None], percent))
        x, y = part[x], others[y]
        if self is other:
            keep = (x < y) | ((x > y) & ~np.isin(y, part))
            x, y = x[keep], y[keep]
        return x, y


def _links_of(sets: list, left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs (one of left, one of right) that reach the threshold; each unordered pair of distinct points once if left is right."""
    n = np.array([len(s) for s in sets], np.int64)
    groups = int(min(MOST_GROUPS, max(GROUPS, 1 << int(n.max() // 4).bit_length())))
    vectors = np.stack([np.bincount(s * 0x9E3779B1 >> 7 & groups - 1, minlength=groups) for s in sets]).astype(np.int32)
    tree = Tree(n, vectors, left)
    pairs = list(tree.meet(tree if left is right else Tree(n, vectors, right), percent))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    hit = reaches(_overlaps(sets, a, b), n[a], n[b], percent)
    return a[hit], b[hit]


def _overlaps(sets: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    if len(a) <= 256:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    rows, x = np.unique(a, return_inverse=True)
    cols, y = np.unique(b, return_inverse=True)
    use = np.unique(np.concatenate([rows, cols]))
    sizes = np.array([len(sets[i]) for i in use])
    owner = np.repeat(np.arange(len(use)), sizes)
    _, token, times = np.unique(np.concatenate([sets[i] for i in use]), return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[token]
    owner, token = owner[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    at_row, at_col = np.full(len(use), -1), np.full(len(use), -1)
    at_row[np.searchsorted(use, rows)] = np.arange(len(rows))
    at_col[np.searchsorted(use, cols)] = np.arange(len(cols))
    total, width = np.zeros((len(rows), len(cols)), np.float32), 4096
    for lo in range(0, int(common.sum()), width):
        s, e = np.searchsorted(token, [lo, lo + width])
        o, t = owner[s:e], token[s:e] - lo
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        r, c = at_row[o] >= 0, at_col[o] >= 0
        left[at_row[o[r]], t[r]] = 1
        right[at_col[o[c]], t[c]] = 1
        total += left @ right.T
    return total[x, y].astype(np.int64)


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links per row.

    Two documents link when 100 * intersection >= percent * union of their sets of n consecutive words; component_id is
    the smallest id reachable by links, n_links the number of other rows linked to directly. Null texts and texts
    without words have an empty set, link with nothing and are their own component. Rows without an id link with
    nothing and have component null. Rows that share an id are one node, whatever their texts; each counts as a row in
    n_links. Ids are taken as longs. Further columns are ignored, whatever their names; an empty table gives an
    empty result. A task holds two leaves, so the longest text decides its memory where that exceeds LEAF_BYTES.
    """
    rows, seen, n_rows = _points(docs, n, percent, id_col, text_col)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.withColumn("point", F.monotonically_increasing_id()), "ngram-classes")
    linkable = rows.where("n > 0 and doc_id is not null")
    placed = staged(join_counted(linkable, classes, "digest", n_rows, "copies").select("doc_id", "n", "digest", "point", "rep", "copies"), "ngram-rows")

    tasks = _tasks(seen, classes, percent)
    links = _verify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), classes, tasks, n, percent)
    # rows of one id are one node: their points are tied
    ties = placed.groupBy("doc_id").agg(F.min("point").alias("a"), F.max("point").alias("z")).where("a < z").join(placed.select("doc_id", F.col("point").alias("b")), "doc_id").select("a", "b")
    edges = links.select(F.col("point").alias("a"), F.col("root").alias("b")).unionByName(ties)
    found = connected_components(edges)
    counted = links.groupBy("point").agg(F.sum("links").alias("links"))
    smallest = classes.join(found.withColumnRenamed("node", "point"), "point").groupBy("component").agg(F.min("rep").alias("lowest"))
    grouped = found.withColumnRenamed("node", "point").join(smallest, "component").select("point", "lowest")
    per_class = classes.join(grouped, "point", "left").join(counted, "point", "left").select(
        "digest", "copies", F.coalesce("lowest", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links")
    )
    full = join_counted(placed.select("doc_id", "n", "digest"), per_class, "digest", n_rows, "copies")
    full = staged(full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links"), "ngram-result")
    # rows without words share the component of their id, if other rows of it have words
    of_id = full.groupBy("doc_id").agg(F.min("component_id").alias("c"))
    rest = rows.where("n = 0 or doc_id is null")
    known = rest.where("doc_id is not null").join(of_id, "doc_id", "left")
    alone = known.select("doc_id", "n", "c").unionByName(rest.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("c")))
    return full.unionByName(alone.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of ``ngram_join`` the row with the smallest id, whole and
    once. Of rows that share that id the one with the smallest text stays. Rows without an id link with nothing and stay.

    Only rows that go, and rows that share an id, are dealt by id; the others pass without a shuffle."""
    found = ngram_join(docs, n, percent, id_col, text_col).select("doc_id", "component_id").where("doc_id is not null")
    found = staged(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("doc_id <> component_id or rows > 1"), "ngram-gone")
    key = F.col(id_col).cast("long")
    maybe = hit_filter(found, found.count(), "doc_id")(key) & key.isNotNull()
    rest = [c for c in docs.columns if c != text_col]
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    left = docs.where(maybe).select(key.alias("key"), F.struct(F.col(text_col).alias("text"), F.struct(*rest).alias("rest")).alias("row")).join(gone, "key", "left_anti")
    one = left.groupBy("key").agg(F.min("row").alias("row"))
    columns = {c: F.col("row")["rest"][c] for c in rest} | {text_col: F.col("row")["text"]}
    return docs.where(~maybe | key.isNull()).unionByName(one.select(*[columns[c].alias(c) for c in docs.columns]))


def _points(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, digest of every row; of one row of each text in a block: doc_id, n, bytes, digest, first, tokens, hot;
    rows). ``tokens`` are the n-grams of the point's prefix that others may have, ``hot`` those of the highest level."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base, ranges = in_blocks(docs)

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        column = table.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return [s for _, s in shingle_sets(column, n)]

    def sketch(table: pa.Table) -> pa.Table:
        known = [s for s, i in zip(sets_of(table), table.column("doc_id"), strict=True) if i.is_valid]
        return partial_sketch(table.column("block")[0].as_py(), np.concatenate([*known, np.zeros(0, np.uint64)]), ranges)

    names = ["doc_id", "n", "digest", "bytes", "first", "tokens", "hot"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def prefixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table([pa.array([], k) for k in kinds], names)
        sets, ids = sets_of(table), table.column("doc_id").to_pylist()
        texts = [plain_words(t.as_py()) for t in table.column("text")]
        use = [i for i, s in enumerate(sets) if ids[i] is not None and len(s)]
        levels = levels_of(np.concatenate([*(sets[i] for i in range(len(ids)) if ids[i] is not None), np.zeros(0, np.uint64)]), replies, ranges)
        by_row = dict(zip((i for i in range(len(ids)) if ids[i] is not None), np.split(levels, np.cumsum([len(s) for i, s in enumerate(sets) if ids[i] is not None])[:-1]), strict=True)) if use else {}
        digests = [_digest(t) for t in texts]
        best: dict[bytes, int] = {}  # of equal texts in a block the smallest id is sent
        for i in use:
            if digests[i] not in best or ids[i] < ids[best[digests[i]]]:
                best[digests[i]] = i
        sent = {i: None for i in best.values()}
        first, tokens, hot = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for i in sent:
            s, level = sets[i], by_row[i]
            pick = np.argsort(level, kind="stable")[: len(s) + 1 - -(-percent * len(s) // 100)]  # of equal levels the smaller hashes
            pick = pick[level[pick] > 1]
            if len(pick):
                first[i] = int(s[level > 1][:1].view(np.int64)[0])
                tokens[i], hot[i] = (s[pick[at]].view(np.int64) for at in (level[pick] < HOT, level[pick] >= HOT))
        columns = [ids, [len(s) for s in sets], digests, [len(t) for t in texts], first, tokens, hot]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    replies = merged_replies(base.groupBy("block").applyInArrow(sketch, PARTIAL), ranges)
    schema = "doc_id long, n int, digest binary, bytes long, first long, tokens array<long>, hot array<long>"
    seen = staged(base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(prefixes, schema), "ngram-sets")
    return seen.select("doc_id", "n", "digest"), seen.where("first is not null"), seen.count()


def meeting(apart: int):
    """The function of batches (token, leaf, point, before) that gives the points that meet in each pair of leaves; bands of leaves
    that differ by more than ``apart`` don't meet."""
    import pyarrow as pa

    def meet(batches):
        """Rows sorted by n-gram, leaf and point, an n-gram at a time: the points that it brings into each task.

        Near copies share runs of n-grams. Points whose n-grams before this one are equal met at that one already (it is in
        both prefixes, and so on back to the first of the run), so they don't meet again here."""
        held: list = []

        def out(rows: np.ndarray):
            rows = np.unique(rows, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], ["left", "right", "home", "point"])

        def groups(rows: np.ndarray):
            """(leaf, point, run) of each n-gram of several points that aren't all of one run."""
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            size = np.diff(np.append(starts, len(rows)))
            run = np.where(rows[:, 4] != 0, -1 - np.arange(len(rows)), rows[:, 3])  # without an n-gram before, a run of its own
            first = rows[:, 4] != 0
            same = (run == np.repeat(run[starts], size)) & ~first
            for g in np.flatnonzero((size > 1) & ~np.logical_and.reduceat(same, starts)).tolist():
                s, e = starts[g], starts[g] + size[g]
                ids = np.unique(np.stack([first[s:e], run[s:e]], 1), axis=0, return_inverse=True)[1].reshape(-1)
                yield rows[s:e, 1], rows[s:e, 2], ids

        def tasks_of(leaf: np.ndarray, point: np.ndarray, run: np.ndarray) -> np.ndarray:
            leaves, at = np.unique(leaf, return_inverse=True)
            here = np.zeros((run.max() + 1, len(leaves)), np.int64)  # points per run and leaf
            np.add.at(here, (run, at), 1)
            who, other = np.nonzero((here.sum(0) > here[run]) & (np.abs((leaf >> BAND_BITS)[:, None] - (leaves >> BAND_BITS)) <= apart))
            mine, other = leaf[who], leaves[other]
            return np.stack([np.minimum(mine, other), np.maximum(mine, other), mine, point[who]], 1)

        for b in batches:
            before = b.column(3)
            held.append(np.stack([*(b.column(i).to_numpy() for i in range(3)), before.fill_null(0).to_numpy(), before.is_null().to_numpy(zero_copy_only=False)], 1))
            rows = np.concatenate(held)
            cuts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
            if len(cuts) > 1:  # the last n-gram may go on in the next batch
                held = [rows[cuts[-1] :]]
                if found := [tasks_of(*g) for g in groups(rows[: cuts[-1]])]:
                    yield out(np.concatenate(found))
        if held and len(rows := np.concatenate(held)) > 1:
            if found := [tasks_of(*g) for g in groups(rows)]:
                yield out(np.concatenate(found))

    return meet


def _tasks(seen: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(left, right, home, point): the points (each of leaf ``home``) of leaves ``left`` <= ``right`` that share a coordinate of their prefixes with a
    point of the other leaf (or another of the same)."""
    spark = seen.sparkSession
    points = seen.join(classes, "digest").where("doc_id = rep").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BAND)))).cast("int"))
    points = staged(points.select("point", "band", "first", "bytes", "tokens", "hot"), "ngram-points")
    sizes = lambda *by: points.groupBy(*by).agg(F.greatest(F.count(F.lit(1)) / LEAF_POINTS, F.sum("bytes") / LEAF_BYTES).alias("leaves"))
    bits = {r["band"]: max(0, ceil(log2(r["leaves"]))) for r in sizes("band").collect()}  # a row per band, so a hundred or so
    if not bits:
        return spark.createDataFrame([], "left long, right long, home long, point long")
    # sets that link differ in size by 100 / percent at most, so by this many bands
    apart = floor(log(100 / percent) / log(BAND)) + 1
    shift = F.lit(0)
    for band, b in bits.items():
        shift = F.when(F.col("band") == band, F.lit(b)).otherwise(shift)
    # leaf: band, top bits of the first coordinate, and a part by point where too many share those
    top = F.shiftrightunsigned("first", 1)
    cell = (F.col("band").cast("long") * F.lit(1 << 32)) + F.call_function("shiftright", top, (F.lit(63) - shift).cast("int"))
    points = points.withColumn("cell", cell)
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.greatest(F.count(F.lit(1)) / LEAF_POINTS, F.sum("bytes") / LEAF_BYTES)).alias("parts"))
    n_points = points.count()
    placed = join_counted(points.select("point", "cell", "tokens", "hot"), cells, "cell", n_points, "m")
    placed = staged(placed.withColumn("leaf", F.col("cell") * F.lit(1 << BAND_BITS - 32) + F.pmod(F.xxhash64("point"), "parts")).select("point", "leaf", "tokens", "hot"), "ngram-leaves")

    # a token of a level below HOT is in few documents; ``before`` is the one next before it in the point's prefix
    chain = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.when(i > 0, F.get("tokens", i - 1)).alias("before")))
    usual = placed.select(F.explode(chain).alias("t"), "leaf", "point").select("t.token", "leaf", "point", "t.before")
    met = usual.repartition("token").sortWithinPartitions("token", "leaf", "point").mapInArrow(meeting(apart), "left long, right long, home long, point long")
    hot = placed.select(F.explode("hot").alias("token"), "leaf", "point")
    held = hot.groupBy("token", "leaf").agg(F.count(F.lit(1)).alias("m"))
    one, two = (held.select("token", F.col("leaf").alias(side), F.col("m").alias(f"m_{side}")) for side in ("left", "right"))
    near = F.abs(F.shiftright("left", BAND_BITS) - F.shiftright("right", BAND_BITS)) <= apart
    pairs = one.join(two, "token").where("left < right or (left = right and m_left > 1)").where(near).select("token", "left", "right")
    into = pairs.select("token", F.col("left").alias("leaf"), "left", "right").unionByName(pairs.where("left < right").select("token", F.col("right").alias("leaf"), "left", "right"))
    crowd = hot.join(into, ["token", "leaf"]).select("left", "right", F.col("leaf").alias("home"), "point")
    return staged(met.unionByName(crowd).distinct(), "ngram-tasks")


def _verify(docs: DataFrame, classes: DataFrame, tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """(point, root, links) per task: a forest of the links found there and the copies at the other ends of a point's links."""
    import pyarrow as pa

    wanted = tasks.select("point").distinct().join(classes, "point")
    wanted = staged(wanted, "ngram-wanted")
    total = wanted.count()

    def plain(batches):
        for b in batches:
            words = [plain_words(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, words), pa.binary()), pa.array(words, pa.binary())], ["rep", "digest", "words"])

    near = docs.where(hit_filter(wanted, total, "rep")(F.col("doc_id"))).mapInArrow(plain, "rep long, digest binary, words binary")
    points = near.join(wanted, ["digest", "rep"]).dropDuplicates(["digest"]).select("point", "copies", "words")
    work = tasks.join(staged(points, "ngram-texts"), "point")

    def verify(table: pa.Table) -> list:
        left = table.column("left")[0].as_py()
        sets = exact_sets(table.column("words").to_pylist(), n)
        ids, copies = table.column("point").to_numpy(), table.column("copies").to_numpy()
        side = table.column("home").to_numpy() == left
        a = np.flatnonzero(side)
        a, b = _links_of(sets, a, a if side.all() else np.flatnonzero(~side), percent)
        if not len(a):
            return []
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        nodes, root = forest(ids[a], ids[b])
        by_id = dict(zip(nodes.tolist(), root.tolist(), strict=True))
        return [(int(ids[i]), by_id[int(ids[i])], int(links[i])) for i in np.flatnonzero(links)]

    def run(batches):
        """Rows sorted by task, one task after another."""
        held: list = []

        def rows_of(found):
            c = list(zip(*found, strict=True)) if found else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["point", "root", "links"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(2)], 1)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            found = []
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (key[s, 0], key[s, 1]):
                    found += verify(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
            yield rows_of(found)
        if held:
            yield rows_of(verify(pa.Table.from_batches(held)))

    work = work.select("left", "right", "home", "point", "copies", "words").repartition("left", "right").sortWithinPartitions("left", "right")
    return staged(work.mapInArrow(run, "point long, root long, links long"), "ngram-links")
