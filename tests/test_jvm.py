"""JVM functions against Python, and plans that leave the costly work there."""

import math
import random
import re

import regex
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators.vectors import hashed_list, packed
from palimpsest.plans import align


def texts(n=400):
    r = random.Random(3)
    parts = ["\xad", "\xa0", " ", "\t", "\n", "\n", " ", "\x1c", "\x85", "a", "É", "中文", "\U0001d54f", "_", "7", "٣", ".", "-", "word"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(n)]


def test_texts_against_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate([*texts(), None])), "k int, t string")
    rows = df.select("t", T.normalize_text(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s"), T.n_words(F.col("t")).alias("w"), F.length(V.hashed(F.col("t"), 64)).alias("size")).collect()
    blank = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
    strip = lambda t: regex.sub(f"^{blank}+|{blank}+$", "", t)
    for r in rows:
        if r["t"] is None:
            assert (r["n"], r["s"], r["w"], r["size"]) == (None, None, None, 0)
            continue
        assert r["n"] == strip(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", r["t"].replace("\xad", "").replace("\xa0", " "))))
        assert (r["s"], r["w"]) == (strip(r["t"]), len(regex.findall(r"[\p{L}\p{N}_]+", r["t"])))


def test_vectors_and_cosines(spark):
    known = texts(40)
    df = spark.createDataFrame(list(enumerate(known)), "k int, t string").withColumn("v", V.hashed(F.col("t"), 64))
    norm = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    want = {k: norm(hashed_list(t, 64)) for k, t in enumerate(known)}
    entries = df.select("k", F.inline(V.unpacked(F.col("v")))).collect()
    assert all(abs(r["w"] - want[r["k"]][r["bucket"]]) < 1e-12 for r in entries) and len(entries) == sum(x > 0 for v in want.values() for x in v)
    again = packed(df.select("k", F.inline(V.unpacked(F.col("v")))), ["k"]).withColumnRenamed("vec", "u")
    assert again.join(df, "k").where("u <> v").count() == 0
    pairs = df.select(F.col("k").alias("a"), F.col("v").alias("x")).crossJoin(df.select(F.col("k").alias("b"), F.col("v").alias("y")))
    for r in pairs.select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("cos")).collect():
        assert abs(r["cos"] - sum(p * q for p, q in zip(want[r["a"]], want[r["b"]], strict=True))) < 1e-9


def test_pairs_are_scored_where_they_are_formed(spark):
    rows = [("p", side, f"{side}{i}", "paragraph", ["1"], 1, 5, f"text number {i} of some words", i) for side in ("legacy", "modern") for i in range(6)]
    nodes = spark.createDataFrame(rows, "pair_id string, doc_side string, node_id string, kind string, path array<string>, page int, token_count int, text string, leaf_pos int")
    p = align.score_pairs(align.candidate_pairs(*align.sides(nodes.withColumn("vec", V.hashed(F.col("text"), 768))), ["pair_id"]), 0.75)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("palimpsest_terms") <= 1
    assert p.count() == 36 and p.where("legacy_pos = modern_pos").agg(F.min("cos")).first()[0] > 1 - 1e-9


def test_pairs_of_one_group_are_spread(spark):
    rows = [("p", side, f"{side}{i}", "section", ["1"], 1, 5, f"title {i}", i) for side in ("legacy", "modern") for i in range(64)]
    nodes = spark.createDataFrame(rows, "pair_id string, doc_side string, node_id string, kind string, path array<string>, page int, token_count int, text string, leaf_pos int")
    sides = align.sides(nodes)
    spread, whole = (align.candidate_pairs(*sides, ["pair_id"], n) for n in (16, 1))
    keys = ["legacy_id", "modern_id", "heading", "size_bonus"]
    assert spread.count() == 64 * 64 and spread.select(keys).exceptAll(whole.select(keys)).count() == 0
    assert spread.groupBy(F.spark_partition_id()).count().count() > 4


def test_lexical_ratio_of_texts_with_many_equal_runs(spark):
    r = random.Random(11)
    known = ["".join(r.choices(letters, k=n)) for letters in ("ab", "abcdefgh ", "aé中\U0001d54f", "".join(map(chr, range(0x4E00, 0x4F00)))) for n in (1, 7, 60, 199, 200, 450)]
    known += [k[5:40] + k[:30] + "x" + k[31:] for k in known]
    df = spark.createDataFrame([(a, b) for a in known for b in known], "a string, b string")
    for row in df.select("a", "b", align.lexical(F.col("a"), F.col("b")).alias("x")).collect():
        assert row["x"] == align.lexical_ratio(row["a"], row["b"]), (row["a"], row["b"])


def test_pairs_are_formed_in_as_many_tasks_as_the_session_shuffles_into(spark):
    rows = [(str(p), side, f"{side}{i}", "paragraph", ["x"], 1, 1, f"word {i}", i) for p in range(40) for side in ("legacy", "modern") for i in range(3)]
    nodes = spark.createDataFrame(rows, "pair_id string, doc_side string, node_id string, kind string, path array<string>, page int, token_count int, text string, leaf_pos int")
    pairs = align.candidate_pairs(*align.sides(nodes), ["pair_id"])
    tasks = pairs.select(F.spark_partition_id().alias("t"), "pair_id").distinct()
    assert tasks.select("t").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks.count() == 40 and pairs.count() == 360
