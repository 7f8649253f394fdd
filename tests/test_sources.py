"""Which documents become blocks and pairs."""

from palimpsest import queries as Q
from palimpsest.plans.align import lexical_ratio
from palimpsest.sources import adapters


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ROWS = [(i, f"Title\nline {i}\nend") for i in (7, 3, 9, 1, 5, 8)] + [(20, "short"), (21, "short"), (30, "alone\nin its\ngroup"), (40, None), (50, "")]


def test_every_member_of_a_group_is_paired(spark):
    out = adapters.document_pairs(docs(spark, ROWS)).collect()
    pairs = {}
    for r in out:
        pairs.setdefault(r["pair_id"], {})[r["doc_side"]] = r["doc_id"]
    ids = [1, 3, 5, 7, 8, 9]
    assert pairs == {str(a): {"legacy": a, "modern": b} for a, b in [*zip(ids, ids[1:], strict=False), (20, 21)]}
    assert len(out) == 2 * len(pairs)


def test_a_large_group_over_many_ranges(spark):
    rows = [(i, f"same\n{i}\nend") for i in range(2000)] + [(5000 + i, f"{i}\nx\ny") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = adapters.predecessors(adapters.named_documents(docs(spark, rows).repartition(7))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((int(r["before"]), int(r["name"])) for r in out) == [(i, i + 1) for i in range(1999)]


def test_single_documents_and_names(spark):
    out = adapters.single_documents(docs(spark, [*ROWS, (3, "again"), (None, "no id"), (None, "no id")])).collect()
    names = [r["pair_id"] for r in out]
    assert len(names) == len(set(names)) == len(ROWS) - 1 + 3  # all but the null text
    assert {"3", "3#2", "30", "50"} <= set(names) and sum(n.startswith("~") for n in names) == 2


def test_queries_over_all_documents(spark, tmp_path):
    docs(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    blocks = Q.QUERIES["scan_blocks_all"](spark, str(tmp_path)).collect()
    assert {r["pair_id"] for r in blocks} == {str(i) for i, t in ROWS if t is not None}
    assert len(blocks) == sum(len(t.split("\n")) for _, t in ROWS if t is not None)
    counts = {r["pair_id"] for r in Q.QUERIES["compare_documents"](spark, str(tmp_path)).collect()}
    assert counts == {"1", "3", "5", "7", "8", "20"}
    for name in Q.WHOLE:
        assert f"{name}_all" in Q.QUERIES and f"{name}_all" not in Q.ORACLES


def test_pair_scores_over_all_leaf_pairs(spark, tmp_path):
    old = "Report\n1. Scope\nThis policy applies to all the staff.\nRecords are kept for 30 days."
    docs(spark, [(1, old), (2, old.replace("30", "90")), (3, old.replace("staff", "people"))]).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {(r["pair_id"], r["legacy_id"], r["modern_id"]): r for r in Q.QUERIES[name](spark, str(tmp_path)).collect()}
    nodes = Q.document_nodes(spark, str(tmp_path)).where("leaf_pos is not null").collect()
    kind = lambda n: "section" if n["kind"] == "section" else "body"
    ratio = {
        (a["pair_id"], a["node_id"], b["node_id"]): lexical_ratio(a["text"], b["text"])
        for a in nodes for b in nodes if a["pair_id"] == b["pair_id"] and a["doc_side"] == "legacy" and b["doc_side"] == "modern" and kind(a) == kind(b)
    }
    bodies = {(n["pair_id"], n["node_id"]) for n in nodes if kind(n) == "body"}
    assert any((p, a) in bodies for p, a, _ in ratio)
    lex = run("lexical_pairs")
    assert {k: r["lex"] for k, r in lex.items()} == {k: round(v, 6) for k, v in ratio.items()}
    cut = Q.leaf_pairs(Q.document_nodes(spark, str(tmp_path)))
    cos = {tuple(r[c] for c in Q.PAIR): r["cos"] for r in Q._cosines(Q.document_nodes(spark, str(tmp_path))).collect()}
    want = {}
    for r in cut.collect():
        k = tuple(r[c] for c in Q.PAIR)
        section = r["legacy_kind"] == "section"
        extra = 0.05 if section else r["kind_bonus"]
        want[k] = (0.74 if section else 0.82) * cos.get(k, 0.0) + 0.1 * ratio[k] + (0.08 if section else 0.04) * r["heading"] + r["page_bonus"] + extra + r["size_bonus"]
    whole = run("hybrid_score_lexical")
    assert whole.keys() == want.keys() and all(abs(whole[k]["raw"] - v) < 2e-6 for k, v in want.items())
    scored = run("score_pairs")
    assert scored.keys() == {k for k, v in want.items() if v >= 0.75} and all(abs(r["candidate"] - min(1, want[k])) < 2e-6 for k, r in scored.items())
