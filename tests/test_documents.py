"""Leaves and edges of stored documents against the tables of blocks and nodes."""

import random

from pyspark.sql import functions as F

from palimpsest import queries as Q
from palimpsest.functions import documents as D
from palimpsest.operators import tree
from palimpsest.operators.layout import LEAST, SHARE
from palimpsest.plans import align
from palimpsest.sources import adapters

LINES = [
    "", " ", "\xad", "1. Scope", "1.2 Terms of Use", "٣. نطاق", "2) ", "3.4.5", "10. 20 of 30", "ALL CAPITALS HERE", "ÉTUDE DES CAS", "Every Word Titled", "Most Words titled Here Too",
    "- a bullet", "• another one", "* third", "4) numbered item text. And more", "(5) not one", "Ends with a stop.", "Starts upper after it", "starts lower; and ends so;", "Is it? Yes!",
    "Page Header", "page header", "PAGE  HEADER", "İstanbul ΣΑΣ ſ K", "ΟΔΟΣ ΟΔΟΣ", "中文 的 一行", "\U0001d54f\U0001d550 math", "tab\tand\xa0space  runs", "\x1cseparators\x85", "a\x0bb", "...", "word " * 100, "Word " * 130, "X" * 121, "UPPER " * 11,
    "The long title of a numbered part that goes on and on", "9. " + "title of a section that goes beyond the limit of ninety characters, as it is told in full", "x\r", "$1 \\ (a|b)* [c]", " line ",
]


def odd_documents(spark, n=90):
    r = random.Random(5)
    texts = ["\n".join([r.choice(["Title", "1. Title", "", "TITLE OF IT"]), *r.choices(LINES, k=r.randrange(40))]) for _ in range(n)]
    for i in range(0, n, 3):  # versions of one another
        texts[i] = texts[i - 1].replace("a", "o", 2) if i else texts[1]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "Title\nanother text of id 4\n- a bullet"), (4, texts[4]), (None, texts[7]), (None, texts[7]), (200, None), (201, "")]
    return spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")


def test_leaves_are_those_of_the_blocks(spark):
    docs = odd_documents(spark).localCheckpoint()
    for cap in (220, 30):
        blocks = adapters.document_blocks(docs, pairs=adapters.single_documents).localCheckpoint()
        nodes = tree.leaves(tree.build_nodes(blocks, adapters.page_counts(blocks), cap))
        want = nodes.select("pair_id", "leaf_pos", F.regexp_replace("node_id", "^legacy", ""), "kind", "path", "page", "token_count", "text")
        made = adapters.single_documents(docs).select("pair_id", F.posexplode(D.leaves(F.array_join("lines", "\n"), adapters.LINES_PER_PAGE, SHARE, LEAST, cap)).alias("leaf_pos", "leaf"))
        got = made.select("pair_id", "leaf_pos", *[f"leaf.{c}" for c in ("id", "kind", "path", "page", "tokens", "text")])
        found, wanted = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str)
        assert len(found) > 500 and {r[3] for r in found} == {"section", "paragraph", "bullet"}
        assert found == wanted


def test_linked_texts_are_those_of_the_pairs(spark):
    docs = odd_documents(spark).localCheckpoint()
    linked = adapters.linked_texts(docs).collect()
    got = sorted([(r["name"], "legacy", r["text"]) for r in linked if r["followed"]] + [(r["before"], "modern", r["text"]) for r in linked if r["before"] is not None])
    want = sorted((r["pair_id"], r["doc_side"], "\n".join(r["lines"])) for r in adapters.document_pairs(docs).collect())
    assert got == want and len({r["name"] for r in linked}) == len(linked)


def test_lexical_ratio_of_one_text_with_many(spark):
    r = random.Random(8)
    bases = ["".join(r.choices("etaoin shrdlu", [12, 9, 8, 8, 7, 7, 15, 6, 6, 5, 4, 4, 3], k=n)) for n in (40, 63, 64, 65, 128, 150, 192, 199)]
    known = [*bases, *[b[: len(b) // 2] + "é中" + b[len(b) // 3 :] for b in bases], bases[3][:50], "".join(r.choices("abc de", k=16384)), "".join(r.choices("abc de", k=16385))]
    rows = spark.createDataFrame([(b, a) for b in known[:-2] for a in known], "b string, a string").coalesce(1)  # b stays while a changes
    found = rows.select("a", "b", align.lexical(F.col("a"), F.col("b")).alias("x")).collect()
    assert len(found) == len(known) * (len(known) - 2) and all(f["x"] == align.lexical_ratio(f["a"], f["b"]) for f in found)


def test_many_rows_that_are_alike(spark):
    docs = spark.createDataFrame([(None, "Title\nwithout an id")] * 900 + [(7, "Title\nof one id")] * 600 + [(8, "Title\nof one id")], "doc_id long, text string")
    linked = adapters.linked_texts(docs)
    rows = linked.collect()
    assert len({r["name"] for r in rows}) == len(rows) == 1501 and sum(r["followed"] for r in rows) == sum(r["before"] is not None for r in rows) == 1500
    assert {r["text"] for r in rows if r["name"].startswith("~")} == {"Title\nwithout an id"}


def test_edges_in_parts_are_those_of_the_nodes(spark, tmp_path, monkeypatch):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, Q.score_nodes(Q.document_nodes(spark, str(tmp_path))).collect()), key=str)
    assert len(want) > 1000 and any(r[3] is None for r in want) and any(r[4] < 1 for r in want)
    for size in (align.BLOCK, 5):
        monkeypatch.setattr(align, "BLOCK", size)
        assert sorted(map(tuple, Q.QUERIES["score_pairs"](spark, str(tmp_path)).collect()), key=str) == want


def test_pair_scores_need_no_table_of_blocks_or_nodes(spark, tmp_path, monkeypatch):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    for module in (adapters, align, tree, Q):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: (written.append(name), f(df, name))[1])
    found = Q.QUERIES["score_pairs"](spark, str(tmp_path))
    assert set(written) == {"first-lines", "document-links", "leaves"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("palimpsest_edges") == 1 and "Window" not in plan
