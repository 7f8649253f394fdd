"""Sparse vectors as packed columns, their cosines, and the costly terms of the hybrid score, as JVM functions.

A packed vector is the entries that aren't 0, by bucket: four bytes of bucket, eight of weight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import jvm, lexical  # noqa: F401  (the source below uses that of the lexical ratio)

SOURCE = r"""
public class PalimpsestHashed implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object x, Object size) throws Exception {
        String text = x == null ? "" : (String) x;
        int dim = ((Integer) size).intValue();
        int[] counts = new int[dim];
        int used = counted(text, counts);
        long squares = 0;
        for (int b = 0; b < dim; b++) squares += (long) counts[b] * counts[b];
        double norm = Math.sqrt((double) squares);
        java.nio.ByteBuffer out = java.nio.ByteBuffer.allocate(12 * used);
        for (int b = 0; b < dim; b++) if (counts[b] > 0) { out.putInt(b); out.putDouble(counts[b] / norm); }
        return out.array();
    }

    // adds the words of a lower-case text to the counts of their buckets; the number of buckets that were 0
    static int counted(String text, int[] counts) throws Exception {
        java.util.HashMap known = (java.util.HashMap) KNOWN.get();  // words come again in text after text
        if (known == null || known.size() > 50000) KNOWN.set(known = new java.util.HashMap());
        java.security.MessageDigest md5 = null;
        int n = text.length(), used = 0;
        for (int i = 0; i < n; ) {
            int c = text.codePointAt(i), from = i, letters = 0;
            while (PalimpsestTokens.inWord(c)) {
                letters++;
                i += Character.charCount(c);
                if (i >= n) break;
                c = text.codePointAt(i);
            }
            if (letters == 0) i += Character.charCount(c);
            if (letters < 2) continue;
            String word = text.substring(from, i);
            Integer number = (Integer) known.get(word);
            if (number == null) {
                if (md5 == null) md5 = java.security.MessageDigest.getInstance("MD5");
                byte[] d = md5.digest(word.getBytes(java.nio.charset.StandardCharsets.UTF_8));
                number = Integer.valueOf((d[0] & 255) << 20 | (d[1] & 255) << 12 | (d[2] & 255) << 4 | (d[3] & 255) >> 4);
                if (word.length() < 64 && known.size() <= 50000) known.put(word, number);
            }
            if (counts[number.intValue() % counts.length]++ == 0) used++;
        }
        return used;
    }

    private static final ThreadLocal KNOWN = new ThreadLocal();
}

public class PalimpsestPacked implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) {
        scala.collection.Seq entries = (scala.collection.Seq) x;
        java.nio.ByteBuffer out = java.nio.ByteBuffer.allocate(12 * entries.length());
        for (int i = 0; i < entries.length(); i++) {
            org.apache.spark.sql.Row r = (org.apache.spark.sql.Row) entries.apply(i);
            out.putInt(r.getInt(0));
            out.putDouble(r.getDouble(1));
        }
        return out.array();
    }
}

public class PalimpsestUnpacked implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) {
        java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap((byte[]) x);
        Object[] out = new Object[in.remaining() / 12];
        for (int i = 0; i < out.length; i++) out[i] = org.apache.spark.sql.RowFactory.create(new Object[] {Integer.valueOf(in.getInt()), Double.valueOf(in.getDouble())});
        return out;
    }
}

public class PalimpsestCosine implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object x, Object y) { return Double.valueOf(cosine((byte[]) x, (byte[]) y)); }

    static double cosine(byte[] x, byte[] y) {
        if (x == null || y == null) return 0.0;
        java.nio.ByteBuffer a = java.nio.ByteBuffer.wrap(x), b = java.nio.ByteBuffer.wrap(y);
        double sum = 0;
        for (int i = 0, j = 0; i < x.length && j < y.length; ) {
            int p = a.getInt(i), q = b.getInt(j);
            if (p == q) sum += a.getDouble(i + 4) * b.getDouble(j + 4);
            if (p <= q) i += 12;
            if (q <= p) j += 12;
        }
        return sum;
    }
}

public class PalimpsestTerms implements org.apache.spark.sql.api.java.UDF7 {
    public Object call(Object va, Object vb, Object x, Object y, Object rest, Object weight, Object bound) {
        double cos = PalimpsestCosine.cosine((byte[]) va, (byte[]) vb);
        if (bound == null) return new double[] {cos, PalimpsestLexicalRatio.ratio(PalimpsestLexicalRatio.points((String) x), PalimpsestLexicalRatio.points((String) y))};
        double base = ((Double) rest).doubleValue() + ((Double) weight).doubleValue() * cos, least = ((Double) bound).doubleValue();
        if (base + 0.1 + 1e-9 < least) return null;
        if (base > 1 + 1e-9) return new double[] {cos, 0.0};
        int[] a = PalimpsestLexicalRatio.points((String) x), b = PalimpsestLexicalRatio.points((String) y);
        if (base + 0.1 * most(a, b) + 1e-9 < least) return null;
        return new double[] {cos, PalimpsestLexicalRatio.ratio(a, b)};
    }

    // no ratio is above this: characters that both texts have, told apart by their last eight bits
    private static double most(int[] a, int[] b) {
        if (a.length + b.length == 0) return 1.0;
        int[] n = new int[256];
        for (int i = 0; i < a.length; i++) n[a[i] & 255]++;
        long common = 0;
        for (int j = 0; j < b.length; j++) if (n[b[j] & 255]-- > 0) common++;
        return 2.0 * common / (a.length + b.length);
    }
}
"""
ENTRIES = "array<struct<bucket: int, w: double>>"
jvm.add("palimpsest_hashed", "PalimpsestHashed", SOURCE, "binary")
jvm.add("palimpsest_packed", "PalimpsestPacked", SOURCE, "binary")
jvm.add("palimpsest_unpacked", "PalimpsestUnpacked", SOURCE, ENTRIES)
jvm.add("palimpsest_cosine", "PalimpsestCosine", SOURCE, "double")
jvm.add("palimpsest_terms", "PalimpsestTerms", SOURCE, "array<double>", again=False)


def hashed(text: Column, dim: int) -> Column:
    """Counts of hashed lower-case words of two characters or more, L2-normalised, packed."""
    return jvm.call("palimpsest_hashed", F.lower(text), F.lit(dim))


def packed(entries: Column) -> Column:
    """Array of (bucket, weight) by bucket, packed."""
    return jvm.call("palimpsest_packed", entries)


def unpacked(vector: Column) -> Column:
    return jvm.call("palimpsest_unpacked", vector)


def cosine(a: Column, b: Column) -> Column:
    """Of two packed vectors; 0 where one is null."""
    return jvm.call("palimpsest_cosine", a, b)


def terms(va: Column, vb: Column, a: Column, b: Column, rest: Column, weight: Column, least: float | None = None) -> Column:
    """[cosine of va and vb, lexical ratio of a and b]. With ``least``, null where rest + weight * cosine + 0.1 * ratio stays
    below it, by bounds of the ratio where they tell, and the ratio is 0 where the score is above 1 without it."""
    return jvm.call("palimpsest_terms", va, vb, a, b, rest, weight, F.lit(least).cast("double"))
