"""Fixed values of the text functions and scores."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scores as S
from palimpsest.functions import text as T
from palimpsest.plans.align import lexical, lexical_ratio

#: text, numbered heading, path, bullet, tokens, hash
TEXTS = [
    ("1. Scope", True, ["1"], True, 2, "31d33faffed95af7"),
    ("2.3.1 Data retention", True, ["2", "3", "1"], False, 5, "097a6d3083f13238"),
    ("3) Foo", True, ["3"], True, 2, "511a9c13fb5237be"),
    ("1.\nScope", True, ["1"], True, 2, "b1b3e03f0e33da0d"),
    ("1. Scope\nmore", False, None, True, 3, "63820f3d66e13c33"),
    ("2024 was good", True, ["2024"], False, 3, "751995d8d34d01d1"),
    ("• item", False, None, True, 1, "8d534d03d92f5329"),
    ("- item", False, None, True, 1, "8fdaebf12eb14e2c"),
    ("-item", False, None, False, 1, "785a2d7cdf5b0f13"),
    ("1.2.) x", False, None, False, 3, "da30fcceea0eedf8"),
    ("Purpose and Scope", False, None, False, 3, "21ac03bdb39d90a3"),
    ("A.1 Scope", False, None, False, 3, "40e467a225bd9d0a"),
]


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_texts(spark):
    t = [x[0] for x in TEXTS]
    assert [p is not None for p in values(spark, t, T.numbered_path)] == [x[1] for x in TEXTS]
    assert values(spark, t, T.numbered_path) == [x[2] for x in TEXTS]
    assert values(spark, t, T.is_bullet) == [x[3] for x in TEXTS]
    assert values(spark, t, T.token_count) == [x[4] for x in TEXTS]
    assert values(spark, t, T.stable_hash) == [x[5] for x in TEXTS]


def test_normalize_and_split(spark):
    text = "  a­ b \t c\n\n\n\nd "
    assert values(spark, [text, "", None], T.normalize_text) == ["a b c\n\nd", "", None]
    assert values(spark, [text, "", "x"], T.split_paragraphs) == [["a b c", "d"], [], ["x"]]
    assert values(spark, ["Purpose & Scope: Data!", "§§§", "A\nB"], T.slug) == ["purpose-scope-data", "section", "ab"]
    assert values(spark, ["abc", "a" * 150, ""], T.text_prefixes) == [["abc"], ["a" * 70, "a" * 140, "a" * 150], [""]]
    assert values(spark, ["short", "x" * 50], lambda c: T.truncate_text(c, 20)) == ["short", "x" * 17 + "..."]
    assert values(spark, ["a\nb"], T.indent_block) == ["    a\n    b"]


def test_folds(spark):
    one = spark.range(1)
    assert one.select(T.capped_groups(F.array(*map(F.lit, [100, 100, 100, 30, 250, 5])), 220)).first()[0] == [0, 0, 1, 1, 2, 3]
    assert one.select(T.common_prefix(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [1, 2, 4])))).first()[0] == 2
    assert one.select(T.bucket(F.lit("abc"), 768)).first()[0] == 9


PARA = [("paragraph", "paragraph", 0.9, 0.966667, 1.0, 0.03, 0.05, 1.554667, 1.636667), ("paragraph", "bullet", 0.5, 0.966667, 0.0, 0.02, 0.05 * 5 / 7, 0.912381, 1.250533), ("section", "section", 0.8, 0.966667, 1.0, 0.03, 0.05, 0.898667, 0.971680), ("section", "section", 0.8, 0.4, 0.5, 0.0, 0.025, 0.747, None)]


@pytest.mark.parametrize("a,b,c,lex,h,p,size,raw,again", PARA)
def test_hybrid(spark, a, b, c, lex, h, p, size, raw, again):
    score = lambda cos: S.hybrid_score(cos, F.lit(lex), F.lit(h), F.lit(p), F.lit(a), F.lit(b), F.lit(size))
    got = spark.range(1).select(score(F.lit(c)), score(S.clip01(score(F.lit(c))))).first()
    assert abs(got[0] - raw) < 1e-5
    assert again is None or abs(got[1] - again) < 1e-5


def test_features(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    path = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(S.heading_similarity(path(*a), path(*b))) for a, b in (((1, 2), (1, 3)), ((1,), (1, 2)), ((), ()), ((1, 2), (1, 2)))] == [0.5, 0.5, 0, 1]
    assert [one(S.page_bonus(F.lit(1), F.lit(1 + d))) for d in range(5)] == [0.03, 0.02, 0.01, 0.01, 0]
    assert abs(one(S.token_balance(F.lit(5), F.lit(7))) - 0.035714) < 1e-6 and one(S.token_balance(F.lit(0), F.lit(4))) == 0.0125
    kinds = [("section", "section", 1.0), ("paragraph", "paragraph", 0.6), ("paragraph", "bullet", 0.35), ("section", "paragraph", -0.5), (None, "bullet", 0.0)]
    assert [one(S.kind_compatibility(F.lit(a).cast("string"), F.lit(b))) for a, b, _ in kinds] == [k for _, _, k in kinds]
    assert abs(lexical_ratio("Data must be kept for 30 days.", "Data must be kept for 90 days.") - 0.966667) < 1e-6
    assert (lexical_ratio("tide", "diet"), lexical_ratio("diet", "tide")) == (0.25, 0.5)


def test_lexical_column(spark):
    """Character for character what difflib gives, with few and with popular characters, beyond the BMP, and for nulls."""
    rng, texts = random.Random(5), [None, "", "Σίσυφος ΟΔΟΣ", "İstanbul", "𝒳y😀z"]
    for n in (1, 7, 60, 199, 200, 201, 450):
        for letters in ("ab", "abcde ", "abcdefghijklmnopqrstuvwxyz .", "é😀İßabcDEF", "".join(map(chr, range(200, 600)))):
            text = [rng.choice(letters) for _ in range(n)]
            edited = [c if rng.random() < 0.95 else rng.choice(letters) for c in text[rng.randrange(3) :]]
            texts += ["".join(text), "".join(edited)]
    pairs = [(i, i ^ 1) for i in range(len(texts) - 1)] + [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(800)]
    rows = [(k, texts[i], texts[j]) for k, (i, j) in enumerate(pairs)]
    got = spark.createDataFrame(rows, "k int, a string, b string").select("k", lexical(F.col("a"), F.col("b")).alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {k: lexical_ratio(a, b) for k, a, b in rows}


def test_lexical_runs_in_the_jvm(spark):
    """Python took a millisecond a pair, so 40 million pairs of a GB never ended."""
    plan = spark.range(1).select(lexical(F.lit("a"), F.col("id").cast("string")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "palimpsest_lexical_ratio" in plan
