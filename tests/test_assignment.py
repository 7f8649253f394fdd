"""The assignment in the JVM against that in numpy."""

import random

import numpy as np

from palimpsest.operators.assignment import assign, match_edges


def test_assignment_against_numpy(spark):
    r, rows = random.Random(8), []
    for g in range(60):
        n, m = r.randrange(1, 9), r.randrange(1, 9)
        rows += [(g, f"l{i}", f"m{j}", r.choice([0.75, 0.8, 0.9, 1.0]), r.choice([0.1, 0.5]), i, j) for i in range(n) for j in range(m) if r.random() < 0.6]
    edges = spark.createDataFrame(rows, "g int, legacy_id string, modern_id string, candidate double, cos double, legacy_pos int, modern_pos int")
    best = assign(edges, ["g"], 0.75)
    assert "Python" not in best._jdf.queryExecution().executedPlan().toString() and "Pandas" not in best._jdf.queryExecution().executedPlan().toString()
    found = [tuple(x) for x in best.collect()]
    assert set(found) <= set(rows)
    for g in range(60):
        own = [x for x in rows if x[0] == g]
        if not own:
            continue
        column = lambda i: np.array([x[i] for x in own])  # noqa: E731, B023
        keep = match_edges(column(1), column(2), column(3), column(4), np.abs(column(5) - column(6)), 0.75)
        got, want = [x for x in found if x[0] == g], [x for x, k in zip(own, keep, strict=True) if k]
        assert len({x[1] for x in got}) == len({x[2] for x in got}) == len(got)
        total = lambda xs: (round(sum(x[3] - 0.75 for x in xs), 9), len(xs), round(sum(x[4] for x in xs), 9), sum(abs(x[5] - x[6]) for x in xs))
        assert total(got) == total(want)
