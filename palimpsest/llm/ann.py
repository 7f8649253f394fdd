"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every row is indexed. A query looks into the lists of its nearest
centroids and takes asymmetric distances of their rows from tables. A row's asymmetric distance is off by at most the error
of its code (the distance of the vector from its reconstruction), so a row whose asymmetric distance less that error is beyond
the k-th distance found so far can't be among the k nearest; all others are ranked by exact distances of the original vectors,
however many they are. So the lists alone decide the recall, and how many that takes is measured on the sample. Lists are packed into cells of a bounded number of
rows, neighbouring lists together and long ones split, and a task works on one cell at a time.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.llm.common import hashed_sample, staged
from palimpsest.llm.gru import one_thread

#: Most vectors that centroids and codebooks are fitted on, by the order of a hash of the id.
SAMPLE = 20_000
#: Most lists; rows of a cell, about.
MAX_LISTS, CELL = 1024, 16384
#: Allowance for single precision in tables and sums, as a share of the distances and errors compared.
SLACK = 1e-3
#: Share of the true neighbours, within the sample, that the searched lists must hold; sample queries for that.
TARGET, TRIALS = 0.97, 200
PARTS, CODES = 16, 256


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest rows of c for each row of x, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (c * c).sum(1)[None, :] - 2 * x[a : a + 4096] @ c.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


class IvfPq:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.dim, self.parts = dim, max(p for p in range(1, min(PARTS, dim) + 1) if dim % p == 0)
        with one_thread():
            self.coarse = _kmeans(sample, lists, 10, rng)
            rest = sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]]
            width = dim // self.parts
            self.books = [_kmeans(np.ascontiguousarray(rest[:, p * width : (p + 1) * width]), CODES, 8, rng) for p in range(self.parts)]
            self.probes = self._calibrate(sample)

    def _calibrate(self, sample: np.ndarray, k: int = 10) -> int:
        """The fewest lists per query that hold TARGET of the k nearest rows of the sample."""
        at, ranks = _nearest(sample, self.coarse, 1)[:, 0], []
        for i in range(0, min(TRIALS, len(sample))):
            near = _nearest(sample[i : i + 1], sample, k + 1)[0]
            order = np.empty(len(self.coarse), np.int64)
            order[_nearest(sample[i : i + 1], self.coarse, len(self.coarse))[0]] = np.arange(len(self.coarse))
            ranks.append(order[at[near[near != i]]])
        return int(np.quantile(np.concatenate(ranks), TARGET)) + 1

    def cells(self, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(first cell, number of cells) of each list, lists that lie near one another sharing cells."""
        centred = self.coarse - self.coarse.mean(0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0] if len(centred) > 1 else np.zeros(self.dim)
        first, count, cell, filled = np.zeros(len(centred), np.int32), np.ones(len(centred), np.int32), 0, 0
        for i in np.argsort(centred @ axis, kind="stable"):
            n = sizes.get(int(i), 0)
            if filled and filled + n > CELL:
                cell, filled = cell + 1, 0
            first[i], count[i], filled = cell, max(1, -(-n // CELL)), filled + n
            if count[i] > 1:
                cell, filled = cell + int(count[i]), 0
        return first, count

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list of each row, codes of its residual, distance of the row from what its codes stand for)."""
        at = _nearest(x, self.coarse, 1)[:, 0]
        rest, width = x - self.coarse[at], self.dim // self.parts
        codes = [_nearest(np.ascontiguousarray(rest[:, p * width : (p + 1) * width]), b, 1)[:, 0] for p, b in enumerate(self.books)]
        lost = [((rest[:, p * width : (p + 1) * width] - b[codes[p]]) ** 2).sum(1) for p, b in enumerate(self.books)]
        return at, np.stack(codes, 1).astype(np.uint8), np.sqrt(np.sum(lost, 0))

    def distances(self, q: np.ndarray, lists: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances (query, row) of the rows of one list."""
        rest, width = q - self.coarse[lists], self.dim // self.parts
        out = np.zeros((len(q), len(codes)), np.float32)
        for p, b in enumerate(self.books):
            r = rest[:, p * width : (p + 1) * width]
            table = ((r[:, None, :] - b[None]) ** 2).sum(2)
            out += table[:, codes[:, p]]
        return out


def nearest_exact(q: np.ndarray, d: np.ndarray, error: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q (rows, distances) of its k nearest ``vectors``, ties by id, equal (id, distance) once.

    ``d`` are asymmetric distances (query, row), each off by at most ``error`` (per row, or per query and row); infinite
    ones stay out. Distances add up squares in order, in double precision."""
    q, vectors = q.astype(np.float64), vectors.astype(np.float64)

    def exact(i: int, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.sqrt(np.cumsum((vectors[rows] - q[i]) ** 2, 1)[:, -1])

    one, limit = np.unique(ids, return_index=True)[1], np.full(len(q), np.inf)
    for i, row in enumerate(d):  # k rows of different ids bound the k-th distance, the best asymmetric ones closely
        some = one[np.isfinite(row[one])]
        if len(some) >= k:
            limit[i] = exact(i, some[np.argpartition(row[some], k - 1)[:k]]).max()
    with one_thread(), np.errstate(over="ignore", invalid="ignore"):  # what overflows is ranked
        nq, nv = (q * q).sum(1)[:, None], (vectors * vectors).sum(1)[None, :]
        low = d * (1 - SLACK) - error * (1 + SLACK) - 1e-5 * np.sqrt(nq + nv)
        alive = np.isfinite(d) & ~(low > limit[:, None])
        at, top = np.flatnonzero(alive.any(0)), np.square(limit)[:, None]
        near = nq + nv[:, at] - 2 * q @ vectors[at].T  # leaves few rows for the sums in order
        alive = alive[:, at] & ~(near > top + 1e-9 * (top + nq + nv[:, at]))
    out = []
    for i, row in enumerate(alive):
        rows = at[row]
        found = exact(i, rows)
        order = np.lexsort((ids[rows], found))
        rows, found = rows[order], found[order]
        first = np.ones(len(rows), bool)
        first[1:] = (ids[rows][1:] != ids[rows][:-1]) | (found[1:] != found[:-1])
        out.append((rows[first][:k], found[first][:k]))
    return out


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), np.float64).reshape(-1, dim)


def single(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in single precision, within a range whose squares it holds; their distances from the originals)."""
    y = np.clip(x, -1e15, 1e15).astype(np.float32)
    with np.errstate(over="ignore"):
        return y, np.sqrt(((x - y) ** 2).sum(1))


def build(vectors: DataFrame) -> IvfPq | None:
    """Fit on at most SAMPLE of the usable vectors (id, vec) of one length; None if there are none."""
    n = vectors.count()
    if not n:
        return None
    rows = hashed_sample(vectors.select("id", "vec"), "id", SAMPLE).toArrow()
    return IvfPq(single(np.array(rows.column("vec").to_pylist(), np.float64))[0], min(MAX_LISTS, max(1, isqrt(n))))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` holds for, its k nearest other rows found.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows with a
    null id, and vectors that are null, zero, or hold null or non-finite components, take no part, nor do vectors of
    another length than most have. Rows that share an id are never each other's neighbours, and equal rows count once.
    Fewer rows than k give all of them; an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vec") == dims["dim"])
    index, dim = build(rows), dims["dim"]
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and PARTS books of CODES rows

    def post(batches):
        ix = shared.value
        for b in batches:
            x, rounded = single(_matrix(b.column(1), dim))
            lists, codes, lost = ix.encode(x)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(lost + rounded, pa.float64()), b.column(1)], ["list", "id", "code", "error", "vec"])

    posted = staged(rows.select("id", "vec").mapInArrow(post, "list int, id long, code binary, error double, vec array<double>"), "ivf-lists")
    sizes = dict(posted.groupBy("list").count().collect())  # one row per list
    first, count = index.cells(sizes)
    at = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), F.col("list") + 1)
    posted = posted.withColumn("cell", at(first) + F.pmod(F.xxhash64("id"), at(count)).cast("int"))
    probes = probes or index.probes

    def ask(batches):
        ix = shared.value
        for b in batches:
            near = _nearest(single(_matrix(b.column(1), dim))[0], ix.coarse, min(probes, len(ix.coarse)))
            who, cell, lists = [], [], []
            for i, row in enumerate(near):
                by_cell: dict[int, list[int]] = {}
                for x in row:
                    for c in range(first[x], first[x] + count[x]):
                        by_cell.setdefault(c, []).append(int(x))
                who += [i] * len(by_cell)
                cell += by_cell.keys()
                lists += by_cell.values()
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(who), b.column(1).take(who), pa.array(lists, pa.list_(pa.int32()))], ["cell", "query_id", "vec", "lists"])

    asked = rows.where("asks").select("id", "vec").mapInArrow(ask, "cell int, query_id long, vec array<double>, lists array<int>")

    def scan(q: pa.Table, p: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(p):
            ids, listed = p.column("id").to_numpy(), p.column("list").to_numpy()
            codes = np.frombuffer(b"".join(p.column("code").to_pylist()), np.uint8).reshape(len(p), -1)
            error, vectors = p.column("error").to_numpy(), _matrix(p.column("vec"), dim)
            members = {x: np.flatnonzero(listed == x) for x in np.unique(listed).tolist()}
            qid, x, asked_of = q.column("query_id").to_numpy(), _matrix(q.column("vec"), dim), q.column("lists").to_pylist()
            x32, rounded = single(x)
            for a in range(0, len(q), 64):
                d = np.full((min(64, len(q) - a), len(p)), np.inf, np.float32)
                for name, rows_of in members.items():
                    askers = [i for i in range(len(d)) if name in asked_of[a + i]]
                    if askers:
                        d[np.ix_(askers, rows_of)] = shared.value.distances(x32[a : a + len(d)][askers], name, codes[rows_of])
                d[qid[a : a + len(d), None] == ids[None, :]] = np.inf
                for i, (best, exact) in enumerate(nearest_exact(x[a : a + len(d)], np.sqrt(d), error[None, :] + rounded[a : a + len(d), None], ids, vectors, k)):
                    found.append((np.full(len(best), qid[a + i]), ids[best], exact))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64), strict=True)], ["query_id", "vec_id", "score"])

    # a cell takes far more work than its bytes show, so cells are not gathered into fewer partitions
    n_cells = int((first + count).max())
    asked, posted = asked.repartition(n_cells, "cell"), posted.repartition(n_cells, "cell")
    near = asked.groupBy("cell").cogroup(posted.groupBy("cell")).applyInArrow(scan, "query_id long, vec_id long, score double")
    scored = near.dropDuplicates(["query_id", "vec_id", "score"])
    order = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
