import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.exact_dedup import DigestIndex, exact_dedup
from palimpsest.llm.ngram_join import ngram_join
from palimpsest.llm.substring_dedup import remove_repeated_windows

SPACE = r"[^\x20\x09-\x0D]+"


def shingles(text, n=5):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def brute_near(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = components(ids, links)
    return {i: (len(sets[i]), found[i], degree[i]) for i in ids}


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(make, corpus, keep, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else None
    out = exact_dedup(make(corpus), keep=keep, **({"digest": digest} if weak else {})).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    best = {t: (min if keep == "min" else max)(v) for t, v in groups.items()}
    want = {i: (best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in corpus}
    assert len(out) == len(corpus)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out} == want


def test_exact_dedup_edges(make):
    assert exact_dedup(make([])).count() == 0
    out = exact_dedup(make([(None, "a"), (1, "a"), (1, "a"), (None, "b"), (2, None), (3, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in out) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 2, True), (3, 2, 2, False)]


@pytest.mark.parametrize("bits", [1 << 23, 1 << 6])
def test_index_compacts_over_batches(spark, make, monkeypatch, bits):
    """With filters that tell entries apart and with filters too small to do so."""
    from palimpsest.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", bits)
    index = DigestIndex(spark, keep="min", fanout=5)
    for lo in (0, 10, 20):
        index.insert(make([(i, f"t{i % 5}" if i % 2 else f"own{i}") for i in range(lo, lo + 10)]).select("doc_id", "text").repartition(4))
    assert len(index.levels) > 1 and len(index.levels[1]) > 0
    rows = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.entries().collect()}
    want = defaultdict(list)
    for i in range(30):
        want[hashlib.sha256((f"t{i % 5}" if i % 2 else f"own{i}").encode()).digest()].append(i)
    assert rows == {d: (min(v), len(v)) for d, v in want.items()}
    assert index.contains([hashlib.sha256(b"t3").digest(), b"none"]).count() == 1


def test_ngram_join(make, corpus):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join(make(corpus)).collect()}
    assert out == brute_near(corpus)


def test_ngram_join_leaves(make, monkeypatch):
    """A cluster over several leaves gives the same links."""
    import palimpsest.llm.ngram_join as J

    monkeypatch.setattr(J, "LEAF_POINTS", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = base[:]
        w[i] = f"e{i}"
        rows.append((i, " ".join(w + [f"tail{j}" for j in range(i // 4)])))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join(make(rows)).collect()}
    assert out == brute_near(rows)


def test_near_copies_meet_once():
    """Points of two leaves with a run of 500 n-grams in common meet at its first, and again where a run of one of them begins."""
    import palimpsest.llm.ngram_join as J

    far = 9 << J.BAND_BITS
    names = ["token", "leaf", "point", "before"]
    chains = {(1, 10): range(500), (2, 20): range(500), (2, 21): [*range(300), 1000, *range(300, 500)], (far, 30): range(500)}
    rows = sorted((t, leaf, point, b) for (leaf, point), c in chains.items() for t, b in zip(c, [-1, *c]))
    table = pa.table({n: pa.array([None if n == "before" and r[i] < 0 else r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    met = [tuple(r.values()) for b in J.meeting(2)(table.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    assert set(met) == {(1, 2, 1, 10), (1, 2, 2, 20), (1, 2, 2, 21), (2, 2, 2, 20), (2, 2, 2, 21)}
    assert len(met) <= 10


def test_chains_of_near_copies(make):
    """Copies of one text with words put in, so that runs of shared n-grams begin at many places."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        words = [f"w{rng.integers(60 + 200 * g)}" for _ in range(90)]
        for k in range(9):
            text = list(words)
            for _ in range(rng.integers(0, 5)):
                text.insert(rng.integers(len(text)), f"x{rng.integers(4)}")
            rows.append((100 * g + k, " ".join(text[rng.integers(3) :])))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join(make(rows)).collect()}
    assert out == brute_near(rows) and len({c for _, c, _ in out.values()}) < len(rows)


def test_ngram_join_edges(make):
    assert ngram_join(make([])).count() == 0
    out = ngram_join(make([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f"), (2, ""), (3, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out) == [(-1, -1), (2, 2), (3, 3), (4, 4), (4, 4), (9, 4)]
    a, b = "a b c d e f", "g h i j k l"
    out = ngram_join(make([(5, a), (5, b), (3, a), (7, b), (5, None), (8, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 8)]


def test_components_of_hubs(spark):
    links = [(5000, i) for i in range(400)] + [(i, i + 1000) for i in range(400)] + [(9000, 9001)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(400), *range(1000, 1400), 5000]} | {9000: 9000, 9001: 9000}


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(rows, k):
    words = {i: re.findall(SPACE, t or "") for i, t in rows}
    low = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            low.setdefault(tuple(words[i][j : j + k]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if low[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return want


@pytest.mark.parametrize("k,block,items", [(13, 8 << 20, 1 << 21), (3, 5000, 500)])
def test_substring_dedup(make, corpus, k, block, items):
    out = remove_repeated_windows(make(corpus), window=k, block_bytes=block, range_items=items).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == brute_windows(corpus, k)


def thue_morse(n, first="a"):
    """Words of letters a and b that polynomial hashes modulo 2**64 with any odd base confuse."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b ^ (first == "b")] for b in bits)


def test_words_are_told_apart(make):
    x, y = thue_morse(1024), thue_morse(1024, "b")
    rows = [(1, " ".join([x] * 13)), (2, " ".join([y] * 13)), (3, " ".join([x] * 13))]
    out = {r["doc_id"]: r["n_removed"] for r in remove_repeated_windows(make(rows)).collect()}
    assert out == {1: 0, 2: 0, 3: 13}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join(make(rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_colliding_hashes_decide_nothing(corpus, monkeypatch):
    """With word hashes of four bits, windows are still grouped by their words."""
    from palimpsest.llm import common, substring_dedup

    words = common.words_of

    def weak(data, ends, **kw):
        start, stop, text, hashes = words(data, ends, **kw)
        return start, stop, text, [h & np.uint64(15) for h in hashes]

    monkeypatch.setattr(substring_dedup, "words_of", weak)
    rows = sorted(corpus[:100])
    block = substring_dedup.Block(pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}), 1)
    which, _, _, first = block.grouped(np.arange(len(block.at)))
    flat = [w for _, t in rows for w in re.findall(SPACE, t or "")]
    assert [flat[w] for w in which] and len(set(flat)) == first.sum()
    assert all((flat[a] == flat[b]) == (not f) for a, b, f in zip(which[:-1], which[1:], first[1:], strict=True))


def test_sketch_layout():
    from palimpsest.llm.repeat_sketch import ITEM_BYTES, MESSAGE_ITEMS, layout

    for total in (0, 10**6, 10**9, 10**11, 10**12):
        block, items = layout(total)
        assert block // ITEM_BYTES * items >= MESSAGE_ITEMS * (total // ITEM_BYTES)


def test_substring_dedup_edges(make):
    assert remove_repeated_windows(make([])).count() == 0
    t = "a b c d"
    out = remove_repeated_windows(make([(None, t), (5, t), (5, t), (6, t), (1, None), (2, "")]), window=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (1, 0), (2, 0), (5, 0), (5, 0), (6, 4)]


def test_rows_without_copies_write_no_table_of_all_rows(spark, make, corpus, monkeypatch):
    from palimpsest.llm import exact_dedup as module

    made, path = [], module.new_path
    monkeypatch.setattr(module, "new_path", lambda spark, name, *more: made.append(name) or path(spark, name, *more))
    kept = {r["doc_id"] for r in module.without_copies(make(corpus), keep="max").collect()}
    last = {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        last[t or ""] = i
    assert kept == set(last.values())
    assert made and "lsm-log" not in made
