"""The whole comparison on a small document, the assignment against brute force, the queries against DuckDB."""

import itertools
import json
import random
import re

import numpy as np
import pytest

from palimpsest.engine import compare
from palimpsest.operators.assignment import match_edges, solve
from palimpsest.params import Params, load_params
from palimpsest.plans import report
from palimpsest.plans.summarize import describe_edits
from palimpsest.sources.adapters import BLOCKS
from palimpsest.logs import get_logger, setup_logging
from palimpsest.streaming.progress import compare_stream, summary_stream

OLD = [(1, 0, 10, 9, "ACME CORP CONFIDENTIAL"), (1, 1, 50, 14, "1. Scope"), (1, 2, 80, 10, "This policy applies to all staff"), (1, 3, 104, 10, "and contractors."), (1, 4, 150, 10, "• Keep records safe."), (2, 0, 10, 9, "ACME CORP CONFIDENTIAL"), (2, 1, 50, 10, "Records are kept for 30 days."), (2, 2, 90, 14, "2. Retention"), (2, 3, 120, 10, "Delete after 90 days.")]
NEW = [*OLD[:6], (2, 1, 50, 10, "Records are kept for 90 days."), (2, 2, 90, 14, "3. Appeals"), (2, 3, 120, 10, "Staff may appeal.")]


def blocks(spark, *pairs):
    rows = [(pair, side, page, pos, text, 50.0, float(y), 550.0, y + 12.0, float(font), False) for pair, old, new in pairs for side, part in (("legacy", old), ("modern", new)) for page, pos, y, font, text in part]
    return spark.createDataFrame(rows, BLOCKS)


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("reports")
    return compare(blocks(spark, ("p", OLD, NEW), ("same", OLD, OLD)), out_dir=str(out)), out


def test_tree(result):
    nodes = result[0]["nodes"].where("pair_id = 'p' and doc_side = 'legacy' and leaf_pos is not null").orderBy("leaf_pos").collect()
    got = [(n["leaf_pos"], n["node_id"], n["kind"], n["parent_id"], n["token_count"], n["text"]) for n in nodes]
    assert got == [
        (0, "legacy:p01:1:section1", "section", "legacy:p01:page", 2, "1. Scope"),
        (1, "legacy:p01:1:para1", "paragraph", "legacy:p01:1:section1", 8, "This policy applies to all staff and contractors."),
        (2, "legacy:p01:1:para2", "bullet", "legacy:p01:1:section1", 3, "• Keep records safe."),
        (3, "legacy:p02:1:para1", "paragraph", "legacy:p01:1:section1", 6, "Records are kept for 30 days."),
        (4, "legacy:p02:2:section1", "section", "legacy:p02:page", 2, "2. Retention"),
        (5, "legacy:p02:2:para2", "paragraph", "legacy:p02:2:section1", 4, "Delete after 90 days."),
    ]


def test_changes(result):
    rows = result[0]["changes"].where("pair_id = 'p'").orderBy("match_seq").collect()
    assert sorted((r["change_type"], r["legacy_id"] or "", r["modern_id"] or "") for r in rows) == [
        ("added", "", "modern:p02:3:para2"),
        ("added", "", "modern:p02:3:section1"),
        ("removed", "legacy:p02:2:para2", ""),
        ("removed", "legacy:p02:2:section1", ""),
        ("unchanged", "legacy:p01:1:para1", "modern:p01:1:para1"),
        ("unchanged", "legacy:p01:1:para2", "modern:p01:1:para2"),
        ("unchanged", "legacy:p01:1:section1", "modern:p01:1:section1"),
        ("unchanged", "legacy:p02:1:para1", "modern:p02:1:para1"),
    ]
    assert [r["change_type"] for r in rows] == ["unchanged"] * 4 + ["removed"] * 2 + ["added"] * 2
    by = {r["legacy_id"]: r for r in rows if r["legacy_id"]}
    assert abs(by["legacy:p02:1:para1"]["similarity"] - 1.6366) < 1e-3 and abs(by["legacy:p02:1:para1"]["lexical_score"] - 0.9655) < 1e-4
    assert by["legacy:p02:2:para2"]["evidence_ids"] == ["legacy:p02:2:section1", "legacy:p02:2:para2"]
    counts = {r["pair_id"]: r.asDict() for r in result[0]["counts"].collect()}
    assert (counts["p"]["unchanged_count"], counts["p"]["removed_count"], counts["p"]["added_count"]) == (4, 2, 2)
    assert counts["same"]["unchanged_count"] == counts["same"]["match_count"] == 6


def test_every_leaf_once(result):
    leaves = {(r["pair_id"], r["node_id"]) for r in result[0]["nodes"].where("leaf_pos is not null").collect()}
    rows = result[0]["changes"].collect()
    seen = [(r["pair_id"], r[c]) for r in rows for c in ("legacy_id", "modern_id") if r[c]]
    assert len(seen) == len(set(seen)) and set(seen) == leaves
    assert {e for r in rows for e in r["evidence_ids"]} <= {n for _, n in leaves}


def test_reports(result):
    changes, out = result[0]["changes"], result[1]
    text = report.write_markdown(changes, "p", str(out / "one.md"), result[0]["summaries"])
    assert text.startswith("# Policy Diff Report\n") and "### 5. Removed | similarity=0.000" in text and "## Executive summary" in text
    assert "- Unchanged: **4**, Modified: **0**, Added: **2**, Removed: **2**" in text
    record = [json.loads(r["record"]) for r in report.report_json(changes).where("pair_id = 'p'").orderBy("match_seq").collect()]
    assert "similarity" not in record[4] and record[4]["change_type"] == "removed" and "modern_id" not in record[4]
    files = list((out / "markdown" / "pair_id=p").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text().count("### ") == 8
    summary = {r["match_id"]: r["summary"] for r in result[0]["summaries"].collect()}
    assert summary["none::modern:p02:3:para2"] == "Added content in the modern policy. Key text: Staff may appeal."


def test_single_score_mode(spark):
    counts = compare(blocks(spark, ("p", OLD, NEW)), params=Params(score_mode="single"))["counts"].first()
    assert counts["match_count"] == 8


def test_one_side_empty(spark):
    counts = compare(blocks(spark, ("p", OLD, [])))["counts"].first()
    assert (counts["removed_count"], counts["match_count"]) == (6, 6)


def test_progress(spark):
    seen = []
    events = list(compare_stream(blocks(spark, ("p", OLD, NEW)), blocks(spark, ("p", OLD, NEW)).groupBy("pair_id", "doc_side").agg({"page": "max"}).withColumnRenamed("max(page)", "page_count"), callback=seen.append))
    assert [e.percent for e in events] == sorted(e.percent for e in events) and events[-1].stage == "done" and seen == events

    assert [e.stage for e in events].index("embedding") < [e.stage for e in events].index("matching")


def test_summary_stream(spark, result):
    got = list(summary_stream(result[0], "p"))
    want = {r["match_seq"]: r["summary"] for r in result[0]["summaries"].where("pair_id = 'p'").collect()}
    kept = {r["match_seq"]: r for r in result[0]["changes"].where("pair_id = 'p' and change_type <> 'unchanged'").collect()}
    last = {e.message.split()[-1].split("/")[0]: e.summary for e in got}
    assert {int(k): v.split(": ", 1)[1] for k, v in last.items()} == {k: want[k].strip() for k in kept}
    assert list(summary_stream(result[0], "same")) == [] and all(e.percent <= 92 for e in got)


def test_vectors_written(spark, result):
    back = spark.read.parquet(f"{result[1]}/embeddings")
    assert back.count() == result[0]["vectors"].count() > 0 and set(back.columns) == {"pair_id", "doc_side", "node_id", "bucket", "w"}


def test_logs(tmp_path):
    path = setup_logging(tmp_path / "logs")
    get_logger("x").debug("said")
    assert "said" in path.read_text()


def test_describe_edits():
    assert describe_edits("modified", "keep 30 days", "keep 90 days").startswith("Rephrased or replaced '3' with '9'.")
    assert describe_edits("unchanged", "a", "a") == "The wording is substantially similar, with only minor edits. Low impact change."


def test_params(tmp_path):
    (tmp_path / "p.toml").write_text("min_similarity = 0.5\nvector_dim = 64\n")
    p = load_params(str(tmp_path / "p.toml"), {"MIN_SIMILARITY": "0.6", "VECTOR_DIM": " "})
    assert (p.min_similarity, p.vector_dim, p.unchanged_threshold) == (0.6, 64, 0.92)


@pytest.mark.parametrize("seed", range(60))
def test_solver(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 4), rng.randint(1, 4)
    w = np.array([[rng.choice([0, 0, rng.randint(1, 50)]) for _ in range(m)] for _ in range(n)], np.int64)
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    at = (lambda i, j: w[i, j]) if n <= m else (lambda i, j: w[j, i])
    best = max(sum(at(i, j) for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
    pairs = solve(w)
    assert sum(w[i, j] for i, j in pairs) == best and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9, 1e12])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_matching_at_any_scale(scale, seed):
    """Against every one-to-one assignment: largest total score, then cosine, then least shift, at positions up to 20,000."""
    import itertools

    rng = np.random.default_rng(seed)
    n = 5
    left, right = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    score, cosine = rng.integers(1, 4, n * n) * scale, rng.integers(0, 3, n * n) / 4
    shift = rng.integers(0, 20_000, n * n)
    value = lambda edges: (score[edges].sum(), cosine[edges].sum(), -int(shift[edges].sum()))
    best = max(value([i * n + j for i, j in enumerate(p)]) for p in itertools.permutations(range(n)))
    keep = match_edges(left, right, score, cosine, shift, 0.0)
    assert keep.sum() == n and value(np.flatnonzero(keep)) == best


def test_model_vectors_fall_back_to_hashed_ones(spark):
    from palimpsest.operators.vectors import dense, hash_vectors, model_vectors

    rows = spark.createDataFrame([(i, f"keep {i} days and days") for i in range(5)], "k int, text string")
    want = {r["k"]: r["vec"] for r in dense(hash_vectors(rows, ["k"], dim=16), ["k"], 16).collect()}
    for broken in ("no.such.module:f", lambda texts: 1 / 0, lambda texts: [[1.0]] * len(texts)):
        got = {r["k"]: r["vec"] for r in model_vectors(rows, ["k"], broken, dim=16, batch_size=2).collect()}
        assert all(np.allclose(got[k], v) for k, v in want.items())
    got = model_vectors(rows, ["k"], lambda texts: [[float(len(t)), 0.0] for t in texts], dim=2).collect()
    assert {tuple(r["vec"]) for r in got} == {(1.0, 0.0)}


def test_far_positions_decide_ties():
    left, right = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    keep = match_edges(left, right, np.ones(4), np.full(4, 0.5), np.array([15_000, 15_001, 15_002, 15_002]), 0.75)
    assert keep.tolist() == [True, False, False, True]


def test_hungarian_keeps_large_scores(spark):
    from palimpsest.operators.assignment import hungarian

    rows = [("k", i, j, 1e5 * (1 + (3 * i + 5 * j) % 7)) for i in range(12) for j in range(12)]
    out = hungarian(spark.createDataFrame(rows, "k string, i long, j long, score double"), ["k"]).collect()
    assert len(out) == 12 and len({r["i"] for r in out}) == len({r["j"] for r in out}) == 12



def test_ties_go_to_cosine_then_shift():
    left, right = np.array(["a", "a", "b", "b"]), np.array(["x", "y", "x", "y"])
    keep = match_edges(left, right, np.ones(4), np.array([0.5, 0.9, 0.9, 0.5]), np.zeros(4), 0.75)
    assert keep.tolist() == [False, True, True, False]
    keep = match_edges(left, right, np.ones(4), np.full(4, 0.5), np.array([0, 1, 1, 0]), 0.75)
    assert keep.tolist() == [True, False, False, True]


def test_paths_and_islands_against_a_loop(spark):
    """Random pages: the windows give what a loop over the blocks gives."""
    from palimpsest.operators import layout, tree
    from palimpsest.sources.adapters import page_counts

    rng = random.Random(8)
    texts = ["1. One", "2.1 Two", "INTRO", "plain text goes on", "ends with a hy-", "then more.", "• point", "Another idea here."]
    old, y = [], 0
    for page in (1, 2, 3):
        y = 0
        for pos in range(14):
            y += rng.choice([14, 40])
            old.append((page, pos, y, 10, rng.choice(texts) + f" {pos}" * (rng.random() < 0.5)))
    b = blocks(spark, ("p", old, old))
    kept = layout.drop_repeated_headers(b, page_counts(b))
    got = tree.heading_paths(tree.classify(layout.merge_blocks(kept, layout.median_font(kept)))).where("doc_side = 'legacy'").orderBy("pos").collect()
    used = {(r["page"], r["block_pos"]) for r in kept.where("doc_side = 'legacy'").collect()}
    numbered = re.compile(r"^((\d+)(?:\.(\d+))*[.)]?)\s+(.+)$")
    head = lambda t: bool(numbered.match(t)) or t.isupper()
    want, path = [], []
    for page in (1, 2, 3):
        island, before = [], None
        for p, pos, y, _, t in [x for x in old if x[0] == page and (x[0], x[1]) in used]:
            alone = head(t) or t.startswith("• ")
            if island and (alone or y - before > 18):
                want.append("".join(island).strip())
                island = []
            if alone:
                want.append(t)
            else:
                island.append(t[:-1] if t.endswith("-") else t + " ")
                last = t
            before = y + 12
        if island:
            want.append("".join(island).strip() + ("-" if last.endswith("-") else ""))
    assert [r["t"].rstrip("-") for r in got] == [w.rstrip("-") for w in want]
    for r in got:
        if r["heading"]:
            m = numbered.match(r["t"])
            path = m[1].rstrip(".)").split(".") if m else path or [re.sub(r"\s+", "-", r["t"].lower())]
        assert r["path"] == path
