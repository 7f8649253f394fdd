"""Pairs of leaves that are formed block by block, against those formed row by row."""

import random

from pyspark.sql import functions as F

from palimpsest import queries as Q
from palimpsest.operators import tree
from palimpsest.params import Params
from palimpsest.plans import align
from palimpsest.sources import adapters

NODES = "pair_id string, doc_side string, node_id string, kind string, path array<string>, page int, token_count int, text string, leaf_pos int"


def leaves(spark, n, kinds=("section",)):
    r = random.Random(3)
    texts = ["", "One title", "ONE TITLE", "One title of it", "É中 title \U0001d54f", "Another one of them", "x" * 230, *["".join(r.choices("abc de", k=60)) for _ in range(9)]]
    rows = [(p, side, f"{side}{i}", r.choice(kinds), r.choice([[], ["1"], ["1", "2"]]), r.randrange(1, 9), r.randrange(1, 9), r.choice(texts), i) for p in "pq" for side in ("legacy", "modern") for i in range(n if p == "p" else 3)]
    return spark.createDataFrame([*rows, ("z", "legacy", "legacy0", "section", ["1"], 1, 1, "alone", 0)], NODES)


def test_every_pair_has_its_ratio(spark):
    nodes = leaves(spark, 600)
    got = {(r["pair_id"], r["legacy_id"], r["modern_id"]): r["lex"] for r in align.block_ratios(*align.sides(nodes), ["pair_id"]).collect()}
    text = {(r["pair_id"], r["node_id"]): r["text"] for r in nodes.collect()}
    assert len(got) == 600 * 600 + 9
    want = {}
    for (p, a, b), x in got.items():
        pair = text[p, a], text[p, b]
        if pair not in want:
            want[pair] = round(align.lexical_ratio(*pair), 6)
        assert x == want[pair]


def test_sections_are_those_of_the_whole_tree(spark):
    pages = Q.table(spark, "/root/testdata/sf0.001", "pages")
    blocks = adapters.page_blocks(pages).localCheckpoint()
    columns = ["pair_id", "doc_side", "node_id", "page", "kind", "path", "text", "token_count"]
    want = tree.leaves(tree.build_nodes(blocks, adapters.page_counts(blocks)), "section").select(columns)
    got = tree.sections(blocks, adapters.page_counts(blocks))
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_edges_of_blocks_are_those_of_the_pairs(spark):
    nodes = leaves(spark, 300, ("section", "paragraph", "bullet", "clause"))
    columns = ["pair_id", "legacy_id", "modern_id", "lex", "candidate"]
    want = Q.score_nodes(nodes).select(columns)
    for given in (nodes, Q.with_vectors(nodes)):
        edges = align.block_edges(*align.sides(given), ["pair_id"], Params(), "id")
        got = edges.select("pair_id", "legacy_id", "modern_id", F.round("lex", 6).alias("lex"), F.round("candidate", 6).alias("candidate"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 1000
    assert edges.join(nodes.where("kind = 'clause'").select("pair_id", F.col("node_id").alias("legacy_id")), ["pair_id", "legacy_id"]).count() > 0


def test_leaves_of_texts_have_the_sections_of_the_trees(spark):
    rows = [(i, "\n".join(["Title", "words at first.", "1. SCOPE", "A sentence.", "• a point", "x " * 9 + str(i), "2. Terms", "Last one."][: 3 + i])) for i in range(6)] + [(9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = adapters.document_blocks(docs).localCheckpoint()
    want = align.leaves_of(tree.build_nodes(blocks, adapters.page_counts(blocks)))
    got = align.document_leaves(adapters.linked_texts(docs), Params(), adapters.LINES_PER_PAGE)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("section_id is not null and kind <> 'section'").count() > 5


def test_fallback_covers_the_pages(spark):
    d = "/root/testdata/sf0.001"
    found = Q.QUERIES["match_fallback"](spark, d).localCheckpoint()
    nodes = Q.page_nodes(spark, d)
    pages = found.join(nodes.select("pair_id").distinct(), "pair_id")
    rows = pages.collect()
    assert rows and len({(r["pair_id"], r["legacy_id"]) for r in rows}) == len({(r["pair_id"], r["modern_id"]) for r in rows}) == len(rows)
    stages = align.align_stages(nodes)
    assert sorted((r["pair_id"], r["legacy_id"], r["modern_id"]) for r in rows) == sorted((r["pair_id"], r["legacy_id"], r["modern_id"]) for r in stages["fallback"].collect())
