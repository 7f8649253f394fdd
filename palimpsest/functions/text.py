"""Text functions as column expressions. Character classes are spelled out because \\w and \\d cover ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import jvm

WORD = r"[\p{L}\p{N}_]+"
#: White space that trimming removes, as a class that Java and RE2 read alike.
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
HEADER = r"^[\p{L}\p{N}_\s\-.,:/()|]+$"
NUMBERED = r"^((\p{Nd}+)(?:\.(\p{Nd}+))*[.)]?)\s+([^\n]+)$"
BULLET = r"^([•\-*]|\p{Nd}+[.)])\s+"

#: Fixed limits of the heading rules.
HEADING_WORDS, HEADING_CHARS, UPPER_WORDS, LARGE_WORDS = 18, 120, 10, 12
BOLD_RATIO, LARGE_RATIO, LIKE_RATIO = 1.15, 1.35, 1.20
LIKE_WORDS, LIKE_UPPER_CHARS, LIKE_TITLE_CHARS = 14, 80, 70
HEADER_CHARS, TITLE_CHARS = 120, 90


#: The two below, without regular expressions: these took most of the time of tree building.
SOURCE = r"""
public class PalimpsestNormalized implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) { return x == null ? null : normal((String) x); }

    static String normal(String s) {
        int n = s.length(), newlines = 0;
        StringBuilder out = new StringBuilder(n);
        boolean gap = false;
        for (int i = 0; i < n; i++) {
            char c = s.charAt(i);
            if (c == 0xad) continue;
            if (c == ' ' || c == '\t' || c == 0xa0) {
                if (!gap) out.append(' ');
                gap = true;
                newlines = 0;
                continue;
            }
            gap = false;
            newlines = c == '\n' ? newlines + 1 : 0;
            if (newlines <= 2) out.append(c);
        }
        return PalimpsestStripped.strip(out.toString());
    }
}

public class PalimpsestStripped implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) { return x == null ? null : strip((String) x); }

    static String strip(String s) {
        int from = 0, to = s.length();
        while (from < to && blank(s.charAt(from))) from++;
        while (to > from && blank(s.charAt(to - 1))) to--;
        return s.substring(from, to);
    }

    private static boolean blank(char c) {
        if (c <= ' ') return c == ' ' || c >= 9 && c <= 13 || c >= 0x1c;
        if (c == 0x85) return true;
        int type = Character.getType(c);
        return type == Character.SPACE_SEPARATOR || type == Character.LINE_SEPARATOR || type == Character.PARAGRAPH_SEPARATOR;
    }
}

public class PalimpsestTokens implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) { return x == null ? null : Integer.valueOf(count((String) x)); }

    static int count(String s) {
        int found = 0, n = s.length();
        boolean within = false;
        for (int i = 0; i < n; ) {
            int c = s.codePointAt(i);
            boolean now = inWord(c);
            if (now && !within) found++;
            within = now;
            i += Character.charCount(c);
        }
        return found;
    }

    static boolean inWord(int c) {
        if (c < 128) return c >= 'a' && c <= 'z' || c >= 'A' && c <= 'Z' || c >= '0' && c <= '9' || c == '_';
        int type = Character.getType(c);  // letters have the types 1 to 5, numbers 9 to 11
        return type >= 1 && type <= 5 || type >= 9 && type <= 11;
    }
}
"""
jvm.add("palimpsest_normalized", "PalimpsestNormalized", SOURCE, "string")
jvm.add("palimpsest_stripped", "PalimpsestStripped", SOURCE, "string")
jvm.add("palimpsest_tokens", "PalimpsestTokens", SOURCE, "int")


def strip(text: Column) -> Column:
    """Without the BLANK characters at both ends."""
    return jvm.call("palimpsest_stripped", text)


def normalize_text(text: Column) -> Column:
    """Soft hyphens go, no-break spaces become spaces, runs of spaces and tabs one space, three or more newlines two."""
    return jvm.call("palimpsest_normalized", text)


def n_words(text: Column) -> Column:
    """Number of words()."""
    return jvm.call("palimpsest_tokens", text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), n_words(text))


def stable_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def node_id(side: Column, page: Column, path: Column, kind: str, n: Column) -> Column:
    where = F.when(F.size(path) > 0, F.array_join(path, ".")).otherwise(F.lit("root"))
    return F.format_string("%s:p%02d:%s:%s%d", side, page, where, F.lit(kind), n)


def header_candidate(text: Column) -> Column:
    t = normalize_text(text)
    return (F.length(t) <= HEADER_CHARS) & t.rlike(HEADER) & t.rlike(r"\p{L}")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def heading_like(text: Column, normal: bool = False) -> Column:
    """``normal``: the text is normalised already; doing it again would only make the expression larger."""
    t = text if normal else normalize_text(text)
    n = n_words(t)
    titled = F.size(F.filter(words(t), lambda x: x.rlike(r"^\p{Lu}")))
    return (
        (t != "")
        & (n <= LIKE_WORDS)
        & (
            t.rlike(NUMBERED)
            | ((F.length(t) <= LIKE_UPPER_CHARS) & is_upper(t) & (n <= UPPER_WORDS))
            | ((F.length(t) <= LIKE_TITLE_CHARS) & ~t.rlike(r"[.!?]") & (titled >= F.greatest(F.lit(1), n - 1)))
        )
    )


def is_heading(text: Column, font: Column, bold: Column, median: Column, normal: bool = False) -> Column:
    t = text if normal else normalize_text(text)
    n = n_words(t)
    return (
        (t != "")
        & (F.length(t) <= HEADING_CHARS)  # long texts are told by their length alone
        & (n <= HEADING_WORDS)
        & (
            t.rlike(NUMBERED)
            | (is_upper(t) & (n <= UPPER_WORDS))
            | (bold & (font >= median * BOLD_RATIO) & (n <= LARGE_WORDS))
            | ((font >= median * LARGE_RATIO) & (n <= LARGE_WORDS))
            | (heading_like(t, True) & (font >= median * LIKE_RATIO))
        )
    )


def is_bullet(text: Column, normal: bool = False) -> Column:
    return (text if normal else normalize_text(text)).rlike(BULLET)


def numbered_path(text: Column, normal: bool = False) -> Column:
    """Path of a numbered heading, else null."""
    t = text if normal else normalize_text(text)
    number = F.regexp_replace(F.regexp_extract(t, NUMBERED, 1), r"[.)]+$", "")
    return F.when(t.rlike(NUMBERED), F.filter(F.split(number, r"\."), lambda x: x != ""))


def slug(text: Column, normal: bool = False) -> Column:
    s = F.regexp_replace(F.lower(text if normal else normalize_text(text)), r"[^a-z0-9.\- ]+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def short_title(text: Column, normal: bool = False) -> Column:
    t = F.regexp_replace(text if normal else normalize_text(text), r"\s+", " ")
    return F.when(F.length(t) > TITLE_CHARS, F.regexp_replace(F.substring(t, 1, TITLE_CHARS), f"{BLANK}+$", "")).otherwise(t)


def split_paragraphs(text: Column, normal: bool = False) -> Column:
    """Paragraphs between blank lines; the whole text if there are none."""
    t = text if normal else normalize_text(text)
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def truncate_text(text: Column, limit: int) -> Column:
    t = strip(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, limit - 3)), f"{BLANK}+$", ""), F.lit("...")))


def path_text(path: Column) -> Column:
    return F.array_join(F.filter(path, lambda x: x != ""), " > ")


def indent_block(text: Column, prefix: str = "    ") -> Column:
    return F.regexp_replace(text, r"(?m)^", prefix)


def text_prefixes(text: Column, step: int = 70) -> Column:
    """The growing prefixes that a summary is shown by; one empty prefix for an empty text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / step).cast("int"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, F.lit(1), i * step))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    step = lambda acc, e: F.struct((acc["n"] + (acc["go"] & e).cast("int")).alias("n"), (acc["go"] & e).alias("go"))
    return F.aggregate(same, start, step, lambda acc: acc["n"])


def capped_groups(counts: Column, cap: int) -> Column:
    """Greedy groups of consecutive counts: a group is closed when the next count would exceed the cap."""
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("ids"), F.lit(0).alias("cur"))

    def step(acc, x):
        stay = (acc["run"] == 0) | (acc["run"] + x <= cap)
        cur = F.when(stay, acc["cur"]).otherwise(acc["cur"] + 1)
        return F.struct(F.when(stay, acc["run"] + x).otherwise(x).alias("run"), F.array_append(acc["ids"], cur).alias("ids"), cur.alias("cur"))

    return F.aggregate(counts, start, step, lambda acc: acc["ids"])


def bucket(token: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long"), F.lit(dim)).cast("int")
