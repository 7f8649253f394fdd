"""Optimal one-to-one assignment per group, thresholded.

Edges below the threshold never help, so only edges at or above it come in, and connected parts of a group are solved
one by one. Among matchings of the largest total of score - threshold, that with the largest total cosine wins, then that
with the least total shift of positions. Each of the three is a problem of its own, over the edges that every solution of
the former may use, so no sum of one can outweigh another, whatever the range of scores and positions.

assign() does that in the JVM; match_edges() is the same in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import jvm

#: Scores are told apart to this share of the greatest of a part; cosines to this absolute step.
SCORE_UNITS, COSINE_UNITS = 2**40, 10**9


def _cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each row, reduced costs) of a cheapest perfect matching of a square integer matrix.

    Shortest augmenting paths with potentials, one row at a time."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    big = np.iinfo(np.int64).max // 4
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, via, done = np.full(n + 1, big), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while True:
            done[at] = True
            row = owner[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            via[1:][better] = at
            following = 1 + int(np.where(done[1:], big, least[1:]).argmin())
            delta = least[following]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            at = following
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[via[at]]
            at = via[at]
    column = np.empty(n, np.int64)
    column[owner[1:] - 1] = np.arange(n)
    return column, cost - u[1:, None] - v[None, 1:]


def solve(*weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the matching with the largest total of the first integer matrix, among those of the second, and so on.

    A cell of weight 0 in the first stands for no edge and is left out."""
    n, m = weights[0].shape
    size = max(n, m)
    free, column = np.ones((size, size), bool), np.zeros(size, np.int64)
    for w in weights:
        full = np.zeros((size, size), np.int64)
        full[:n, :m] = w
        span = int(full.max()) - int(full.min())
        closed = span if free.all() else span * size + 1
        if closed * (size + 1) >= 2**61:
            raise OverflowError("weights are too large to be added up exactly")
        # an optimal matching uses cells of reduced cost 0 only, and any perfect matching of such cells is optimal
        column, reduced = _cheapest(np.where(free, full.max() - full, closed))
        free &= reduced == 0
    return [(i, int(j)) for i, j in enumerate(column[:n]) if j < m and weights[0][i, j] > 0]


def match_edges(left: np.ndarray, right: np.ndarray, score: np.ndarray, cosine: np.ndarray, shift: np.ndarray, least: float) -> np.ndarray:
    """Which edges (left, right) belong to the best matching. Scores must be finite; edges are distinct."""
    if not (np.isfinite(score).all() and np.isfinite(cosine).all()):
        raise ValueError("scores and cosines must be finite")
    shift = shift.astype(np.int64)
    ln, li = np.unique(left, return_inverse=True)
    rn, ri = np.unique(right, return_inverse=True)
    part = np.arange(len(ln) + len(rn))
    while True:  # connected parts by spreading the least label
        low = np.minimum(part[li], part[len(ln) + ri])
        before = part.copy()
        np.minimum.at(part, li, low)
        np.minimum.at(part, len(ln) + ri, low)
        if (part == before).all():
            break
    keep = np.zeros(len(left), bool)
    label = part[li]
    order = np.argsort(label, kind="stable")
    for edges in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(edges) == 1:
            keep[edges] = True
            continue
        a, ai = np.unique(li[edges], return_inverse=True)
        b, bi = np.unique(ri[edges], return_inverse=True)
        gain = np.maximum(score[edges] - least, 0)
        tiers = [
            np.rint(gain / (gain.max() or 1) * SCORE_UNITS).astype(np.int64) + 1,
            np.rint(cosine[edges] * COSINE_UNITS).astype(np.int64),
            1 + shift[edges].max() - shift[edges],
        ]
        matrices = [np.zeros((len(a), len(b)), np.int64) for _ in tiers]
        for matrix, values in zip(matrices, tiers, strict=True):
            matrix[ai, bi] = values
        chosen = set(solve(*matrices))
        keep[edges] = [(x, y) in chosen for x, y in zip(ai.tolist(), bi.tolist(), strict=True)]
    return keep


SOURCE = r"""
public class PalimpsestAssigned implements org.apache.spark.sql.api.java.UDF2 {
    /** Places, in the given order, of the edges (legacy_pos, modern_pos, candidate, cos) of the best matching. */
    public Object call(Object x, Object bound) {
        scala.collection.Seq edges = (scala.collection.Seq) x;
        int n = edges.length();
        double least = ((Double) bound).doubleValue();
        long[] left = new long[n], right = new long[n];
        double[] score = new double[n], cosine = new double[n];
        java.util.HashMap lefts = new java.util.HashMap(), rights = new java.util.HashMap();
        int[] l = new int[n], r = new int[n];
        for (int e = 0; e < n; e++) {
            org.apache.spark.sql.Row row = (org.apache.spark.sql.Row) edges.apply(e);
            left[e] = row.getLong(0);
            right[e] = row.getLong(1);
            score[e] = row.getDouble(2);
            cosine[e] = row.getDouble(3);
            if (Double.isNaN(score[e]) || Double.isInfinite(score[e]) || Double.isNaN(cosine[e]) || Double.isInfinite(cosine[e])) throw new IllegalArgumentException("scores and cosines must be finite");
            l[e] = number(lefts, left[e]);
            r[e] = number(rights, right[e]);
        }
        int[] part = new int[lefts.size() + rights.size()];
        for (int i = 0; i < part.length; i++) part[i] = i;
        for (int e = 0; e < n; e++) {
            int a = root(part, l[e]), b = root(part, lefts.size() + r[e]);
            if (a != b) part[Math.max(a, b)] = Math.min(a, b);
        }
        int[] label = new int[n], from = new int[part.length + 1], order = new int[n];
        for (int e = 0; e < n; e++) from[1 + (label[e] = root(part, l[e]))]++;
        for (int i = 0; i < part.length; i++) from[i + 1] += from[i];
        int[] at = (int[]) from.clone();
        for (int e = 0; e < n; e++) order[at[label[e]]++] = e;
        boolean[] keep = new boolean[n];
        for (int i = 0; i < part.length; i++) if (from[i + 1] > from[i]) solve(order, from[i], from[i + 1], left, right, score, cosine, least, keep);
        int kept = 0;
        for (int e = 0; e < n; e++) if (keep[e]) kept++;
        int[] out = new int[kept];
        for (int e = n - 1; e >= 0; e--) if (keep[e]) out[--kept] = e;
        return out;
    }

    private static int number(java.util.HashMap known, long x) {
        Integer found = (Integer) known.get(Long.valueOf(x));
        if (found == null) known.put(Long.valueOf(x), found = Integer.valueOf(known.size()));
        return found.intValue();
    }

    private static int root(int[] part, int i) {
        while (part[i] != i) i = part[i] = part[part[i]];
        return i;
    }

    private static long[] distinct(long[] of, int[] order, int from, int to) {
        long[] all = new long[to - from];
        for (int i = from; i < to; i++) all[i - from] = of[order[i]];
        java.util.Arrays.sort(all);
        int n = 0;
        for (int i = 0; i < all.length; i++) if (i == 0 || all[i] != all[i - 1]) all[n++] = all[i];
        return java.util.Arrays.copyOf(all, n);
    }

    private static void solve(int[] order, int from, int to, long[] left, long[] right, double[] score, double[] cosine, double least, boolean[] keep) {
        if (to - from == 1) {
            keep[order[from]] = true;
            return;
        }
        long[] a = distinct(left, order, from, to), b = distinct(right, order, from, to);
        int size = Math.max(a.length, b.length);
        double most = 0;
        long far = 0;
        for (int i = from; i < to; i++) {
            most = Math.max(most, score[order[i]] - least);
            far = Math.max(far, Math.abs(left[order[i]] - right[order[i]]));
        }
        if (most == 0) most = 1;
        boolean[][] free = new boolean[size][size];
        for (int i = 0; i < size; i++) java.util.Arrays.fill(free[i], true);
        boolean open = true;
        int[] column = null;
        for (int tier = 0; tier < 3; tier++) {
            long[][] cost = new long[size][size];
            long high = 0, low = 0;
            for (int i = from; i < to; i++) {
                int e = order[i], p = java.util.Arrays.binarySearch(a, left[e]), q = java.util.Arrays.binarySearch(b, right[e]);
                long w = tier == 0 ? (long) Math.rint(Math.max(score[e] - least, 0.0) / most * UNITS) + 1 : tier == 1 ? (long) Math.rint(cosine[e] * COSINE_UNITS) : 1 + far - Math.abs(left[e] - right[e]);
                cost[p][q] = w;
                high = Math.max(high, w);
                low = Math.min(low, w);
            }
            if (high > low && to - from == (long) size * size) {  // no cell is 0 by itself
                low = Long.MAX_VALUE;
                high = Long.MIN_VALUE;
                for (int i = 0; i < size; i++) for (int j = 0; j < size; j++) { low = Math.min(low, cost[i][j]); high = Math.max(high, cost[i][j]); }
            }
            long closed = high - low;
            if (!open) closed = Math.addExact(Math.multiplyExact(closed, (long) size), 1L);
            if (Math.multiplyHigh(closed, (long) (size + 1)) != 0 || closed * (size + 1) < 0 || closed * (size + 1) >= 1L << 61) throw new ArithmeticException("weights are too large to be added up exactly");
            for (int i = 0; i < size; i++) for (int j = 0; j < size; j++) cost[i][j] = free[i][j] ? high - cost[i][j] : closed;
            column = new int[size];
            cheapest(cost, column);
            for (int i = 0; i < size; i++) for (int j = 0; j < size; j++) if (cost[i][j] != 0) { free[i][j] = false; open = false; }
        }
        for (int i = from; i < to; i++) {
            int e = order[i];
            keep[e] = column[java.util.Arrays.binarySearch(a, left[e])] == java.util.Arrays.binarySearch(b, right[e]);
        }
    }

    /** Column of each row in a cheapest perfect matching, by shortest augmenting paths; cost becomes the reduced costs. */
    private static void cheapest(long[][] cost, int[] column) {
        int n = column.length;
        long big = Long.MAX_VALUE / 4;
        long[] u = new long[n + 1], v = new long[n + 1], least = new long[n + 1];
        int[] owner = new int[n + 1], via = new int[n + 1];
        boolean[] done = new boolean[n + 1];
        for (int i = 1; i <= n; i++) {
            owner[0] = i;
            int at = 0;
            java.util.Arrays.fill(least, big);
            java.util.Arrays.fill(done, false);
            do {
                done[at] = true;
                int row = owner[at], following = 0;
                long delta = big;
                long[] c = cost[row - 1];
                long base = u[row];
                for (int j = 1; j <= n; j++) if (!done[j]) {
                    long slack = c[j - 1] - base - v[j];
                    if (slack < least[j]) { least[j] = slack; via[j] = at; }
                    if (least[j] < delta) { delta = least[j]; following = j; }
                }
                for (int j = 0; j <= n; j++) {
                    if (done[j]) { u[owner[j]] += delta; v[j] -= delta; }
                    else least[j] -= delta;
                }
                at = following;
            } while (owner[at] != 0);
            while (at != 0) { owner[at] = owner[via[at]]; at = via[at]; }
        }
        for (int j = 1; j <= n; j++) column[owner[j] - 1] = j - 1;
        for (int i = 0; i < n; i++) for (int j = 0; j < n; j++) cost[i][j] -= u[i + 1] + v[j + 1];
    }

    private static final double UNITS = %d.0, COSINE_UNITS = %d.0;
}
""" % (SCORE_UNITS, COSINE_UNITS)  # fmt: skip
jvm.add("palimpsest_assigned", "PalimpsestAssigned", SOURCE, "array<int>")


def assign(edges: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Of ``edges`` (keys, legacy_id, modern_id, candidate, cos, legacy_pos, modern_pos), those of the best matching
    per group. A group is one document pair, or one pair of matched sections; its leaves are told apart by their positions."""
    rest = [c for c in edges.columns if c not in keys]
    first = [F.col("legacy_pos").cast("long").alias("l"), F.col("modern_pos").cast("long").alias("m"), F.col("candidate").cast("double").alias("s"), F.col("cos").cast("double").alias("c")]
    groups = edges.where(edges["candidate"] >= least).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias("es"))
    best = F.transform(jvm.call("palimpsest_assigned", F.col("es"), F.lit(float(least))), lambda i: F.get(F.col("es"), i))
    return groups.select(*keys, F.inline(best)).select(*edges.columns)


def hungarian(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, score of the maximum-total assignment per group of ``scores`` (keys, i, j, score >= 0), no threshold."""
    return assign(scores.selectExpr(*keys, "cast(i as string) legacy_id", "cast(j as string) modern_id", "score candidate", "0.0D cos", "i legacy_pos", "j modern_pos"), keys, 0.0).selectExpr(*keys, "legacy_pos i", "modern_pos j", "candidate score")
