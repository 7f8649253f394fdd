"""Ratio of matching characters of two texts as difflib.SequenceMatcher has it.

As a column it is a JVM function (see ``jvm``): the same search (longest match, earliest in the first text, then in the
second; popular characters of texts of 200 or more left out).
"""

from __future__ import annotations

import difflib

from pyspark.sql import Column

from palimpsest.functions import jvm

NAME = "palimpsest_lexical_ratio"
CLASS = "PalimpsestLexicalRatio"
SOURCE = """
public class PalimpsestLexicalRatio implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object x, Object y) {
        return Double.valueOf(ratio(points((String) x), points((String) y)));
    }

    static double ratio(int[] a, int[] b) {
        int la = a.length, lb = b.length;
        if (java.util.Arrays.equals(a, b)) return 1.0;  // also two empty texts
        if (la == 0 || lb == 0) return 0.0;
        PalimpsestLexicalSpace w = PalimpsestLexicalSpace.of(la, lb);
        if (w.indexed != b) index(w, b);  // one text is compared with many others in turn
        return 2.0 * (lb < FEW && la <= LONG ? narrow(w, a, b) : wide(w, a, b)) / (la + lb);
    }

    // per character of b the chain of its positions, first ones first; the first 1024 characters have a slot of their own
    private static void index(PalimpsestLexicalSpace w, int[] b) {
        int lb = b.length, slots = 0;
        w.indexed = null;
        for (int j = 0; j < lb && slots == 0; j++) if (b[j] >= LOW) for (slots = 64; slots < 2 * lb; ) slots *= 2;
        w.room(LOW + slots);
        int[] key = w.key, first = w.first, count = w.count, at = w.at, place = w.place;
        java.util.Arrays.fill(first, 0, LOW + slots, -1);
        java.util.Arrays.fill(count, 0, LOW + slots, 0);
        for (int j = 0; j < lb; j++) {
            int s = slot(b[j], key, first, slots);
            key[s] = b[j];
            first[s] = 0;
            at[j] = s;
            count[s]++;
        }
        int used = 0;  // places of equal characters of b lie side by side, in order; first is one beyond the last of them
        for (int j = 0; j < lb; j++) {
            int s = at[j];
            if (first[s] == 0) {
                first[s] = used + 1;
                used += count[s];
            }
            place[first[s]++ - 1] = j;
        }
        if (lb < FEW) {  // and as bits
            long[] mask = w.mask(LOW + slots);
            for (int j = 0; j < lb; j++) for (int v = 0; v < 4; v++) mask[4 * at[j] + v] = 0;
            for (int j = 0; j < lb; j++) mask[4 * at[j] + (j >>> 6)] |= 1L << j;
        }
        w.slots = slots;
        w.indexed = b;
    }

    // positions of a whose character b has, if it isn't popular; their number
    private static int shared(PalimpsestLexicalSpace w, int[] a, int lb) {
        int[] key = w.key, first = w.first, count = w.count, from = w.from, to = w.to, some = w.some, free = w.free;
        int la = a.length, slots = w.slots, n = 0, most = lb >= FEW ? lb / 100 + 1 : lb;
        java.util.Arrays.fill(free, 0, la + 1, 0);
        for (int i = 0; i < la; i++) {
            if (a[i] >= LOW && slots == 0) continue;
            int s = slot(a[i], key, first, slots);
            if (first[s] < 0 || count[s] > most) continue;
            to[n] = first[s] - 1;
            from[n] = to[n] - count[s];
            some[n++] = i;
            free[i] = 1;
        }
        for (int i = la - 1; i >= 0; i--) if (free[i] > 0) free[i] += free[i + 1];  // how many such positions follow one another
        return n;
    }

    private static long wide(PalimpsestLexicalSpace w, int[] a, int[] b) {
        int n = shared(w, a, b.length), left = 1;
        int[] todo = w.todo;
        todo[0] = 0;
        todo[1] = a.length;
        todo[2] = 0;
        todo[3] = b.length;
        long total = 0;
        while (left > 0) {
            left--;
            int alo = todo[4 * left], ahi = todo[4 * left + 1], blo = todo[4 * left + 2], bhi = todo[4 * left + 3];
            int best = longest(w, a, b, n, alo, ahi, blo, bhi);
            if (best == 0) continue;
            total += best;
            left = rest(todo, left, alo, ahi, blo, bhi, w.bi, w.bj, best);
        }
        return total;
    }

    private static int rest(int[] todo, int left, int alo, int ahi, int blo, int bhi, int bi, int bj, int best) {
        if (alo < bi && blo < bj) {
            todo[4 * left] = alo; todo[4 * left + 1] = bi; todo[4 * left + 2] = blo; todo[4 * left + 3] = bj;
            left++;
        }
        if (bi + best < ahi && bj + best < bhi) {
            todo[4 * left] = bi + best; todo[4 * left + 1] = ahi; todo[4 * left + 2] = bj + best; todo[4 * left + 3] = bhi;
            left++;
        }
        return left;
    }

    // length of the longest match of a part; w.bi and w.bj are its starts
    private static int longest(PalimpsestLexicalSpace w, int[] a, int[] b, int n, int alo, int ahi, int blo, int bhi) {
        int[] place = w.place, from = w.from, to = w.to, some = w.some, free = w.free;
        int bi = alo, bj = blo, best = 0;
        int t = java.util.Arrays.binarySearch(some, 0, n, alo);
        for (t = t < 0 ? -1 - t : t; t < n; t++) {
            int i = some[t];
            if (i + best >= ahi) break;
            if (free[i] <= best) continue;
            int p = from[t], stop = to[t], last = a[i + best];
            for (int h = blo > 0 ? stop : p; p < h; ) {
                int m = (p + h) >>> 1;
                if (place[m] < blo) p = m + 1; else h = m;
            }
            boolean follows = i > alo && free[i - 1] > 0;
            for (; p < stop; p++) {
                int j = place[p];
                if (j + best >= bhi) break;
                if (b[j + best] != last) continue;  // no longer than the longest so far
                if (follows && j > blo && a[i - 1] == b[j - 1]) continue;  // a run counts from its start
                int k = 1, most = Math.min(free[i], Math.min(ahi - i, bhi - j));
                while (k < most && a[i + k] == b[j + k]) k++;
                if (k > best) {
                    best = k;
                    bi = i;
                    bj = j;
                    if (i + best >= ahi || free[i] <= best) break;
                    last = a[i + best];
                }
            }
        }
        while (bi > alo && bj > blo && a[bi - 1] == b[bj - 1]) { bi--; bj--; best++; }
        while (bi + best < ahi && bj + best < bhi && a[bi + best] == b[bj + best]) best++;
        w.bi = bi;
        w.bj = bj;
        return best;
    }

    // for a b of less than FEW characters: ends[k] has, per position of a, a bit for each position of b where a match of k + 1 ends;
    // run has the longest such match, and rows of ends beyond it aren't there
    private static long narrow(PalimpsestLexicalSpace w, int[] a, int[] b) {
        int[] key = w.key, first = w.first, run = w.run, rows = w.rows;
        long[] mask = w.mask;
        int la = a.length, lb = b.length, slots = w.slots, words = (lb + 63) >>> 6, n = 0;
        long[][] ends = w.ends(la * words);
        long[] one = ends[0];
        for (int i = 0; i < la; i++) {
            run[i] = 0;
            if (a[i] >= LOW && slots == 0) continue;
            int s = slot(a[i], key, first, slots);
            if (first[s] < 0) continue;
            for (int v = 0; v < words; v++) one[i * words + v] = mask[4 * s + v];
            run[i] = 1;
            rows[n++] = i;
        }
        if (n == 0) return 0;
        int levels = 1;
        for (; levels < LEVELS && n > 0; levels++) {
            long[] up = ends[levels], down = ends[levels - 1];
            int kept = 0;
            for (int r = 0; r < n; r++) {
                int i = rows[r];
                if (i == 0 || run[i - 1] < levels) continue;
                long carry = 0, all = 0;
                for (int v = 0, at = i * words; v < words; v++, at++) {
                    long x = down[at - words];
                    all |= up[at] = one[at] & (x << 1 | carry);
                    carry = x >>> 63;
                }
                if (all == 0) continue;
                run[i] = levels + 1;
                rows[kept++] = i;
            }
            n = kept;
        }
        if (n == 0) levels--;
        n = -1;
        int[] todo = w.todo;
        todo[0] = 0;
        todo[1] = la;
        todo[2] = 0;
        todo[3] = lb;
        int left = 1;
        long total = 0;
        while (left > 0) {
            left--;
            int alo = todo[4 * left], ahi = todo[4 * left + 1], blo = todo[4 * left + 2], bhi = todo[4 * left + 3];
            int best = 0, bi = 0, bj = 0, most = Math.min(levels, Math.min(ahi - alo, bhi - blo));
            for (int i = alo; i < ahi && best < most; i++) {  // a match of one more can only end further on
                if (run[i] <= best || i - best < alo) continue;
                int lo = blo + best, j = -1, v = lo >>> 6, to = (bhi - 1) >>> 6;
                long x = ends[best][i * words + v] & -1L << lo;
                while (x == 0 && v < to) x = ends[best][i * words + ++v];
                if (x == 0 || (j = (v << 6) + Long.numberOfTrailingZeros(x)) >= bhi) continue;
                bi = i - best;
                bj = j - best;
                best++;
            }
            if (best == LEVELS) {  // it may be longer than was counted
                if (n < 0) n = shared(w, a, lb);
                best = longest(w, a, b, n, alo, ahi, blo, bhi);
                bi = w.bi;
                bj = w.bj;
            }
            if (best == 0) continue;
            total += best;
            left = rest(todo, left, alo, ahi, blo, bhi, bi, bj, best);
        }
        return total;
    }

    static final int LOW = 1024, FEW = 200, LONG = 16384, LEVELS = 12;  // from FEW characters on, popular ones are left out; the bits of a text take 400 bytes a character at most

    private static int slot(int c, int[] key, int[] first, int slots) {
        if (c < LOW) return c;
        int s = ((c * 0x9E3779B1) >>> 8) & (slots - 1);
        while (first[LOW + s] >= 0 && key[LOW + s] != c) s = (s + 1) & (slots - 1);
        return LOW + s;
    }

    static int[] points(String text) {
        if (text == null) return new int[0];
        return PalimpsestLexicalSpace.points(text);
    }
}

class PalimpsestLexicalSpace {
    private static final ThreadLocal OWN = new ThreadLocal();
    int[] key = new int[0], first = key, count = key, at = key, place = key, from = key, to = key, some = key, free = key, run = key, rows = key, todo = key, indexed;
    long[] mask = new long[0];
    int slots, bi, bj;
    private long[][] ends = new long[PalimpsestLexicalRatio.LEVELS][0];
    private java.util.HashMap known = new java.util.HashMap();  // texts come again in pair after pair
    private int held = 0;

    private static PalimpsestLexicalSpace own() {
        PalimpsestLexicalSpace w = (PalimpsestLexicalSpace) OWN.get();
        if (w == null) OWN.set(w = new PalimpsestLexicalSpace());
        return w;
    }

    static PalimpsestLexicalSpace of(int la, int lb) {
        PalimpsestLexicalSpace w = own();
        if (w.some.length < la) { w.from = new int[la]; w.to = new int[la]; w.some = new int[la]; w.free = new int[la + 1]; w.run = new int[la]; w.rows = new int[la]; }
        if (w.place.length < lb) { w.at = new int[lb]; w.place = new int[lb]; w.indexed = null; }
        int most = 4 * (Math.min(la, lb) + 2);
        if (w.todo.length < most) w.todo = new int[most];
        return w;
    }

    void room(int slots) {
        if (first.length < slots) { key = new int[slots]; first = new int[slots]; count = new int[slots]; }
    }

    long[] mask(int slots) {
        return mask.length < 4 * slots ? mask = new long[4 * slots] : mask;
    }

    long[][] ends(int n) {
        if (ends[0].length < n) for (int k = 0; k < ends.length; k++) ends[k] = new long[n];
        return ends;
    }

    static int[] points(String text) {
        PalimpsestLexicalSpace w = own();
        int[] out = (int[]) w.known.get(text);
        if (out != null) return out;
        String t = text.toLowerCase(java.util.Locale.ROOT);
        out = new int[t.codePointCount(0, t.length())];
        int n = 0;
        for (int i = 0; i < t.length(); i += Character.charCount(out[n - 1])) out[n++] = t.codePointAt(i);
        if ((w.held += n) > 300000) {
            w.known.clear();
            w.held = n;
        }
        if (n <= 300000) w.known.put(text, out);
        return out;
    }
}
"""

def lexical_ratio(a: str | None, b: str | None) -> float:
    """Ratio of matching characters of the lower-cased texts, in this order; it depends on the order."""
    return difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


def lexical(a: Column, b: Column) -> Column:
    """lexical_ratio() of two columns."""
    return jvm.call(NAME, a, b)


jvm.add(NAME, CLASS, SOURCE, "double")
