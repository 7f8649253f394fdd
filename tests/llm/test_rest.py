import hashlib
import math
import random
import tracemalloc
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from palimpsest.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, codec_of
from palimpsest.llm.mixing import poisson_mix
from palimpsest.llm.sharding import minimax_cuts, shard_by_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_capacity(sizes, shards):
    """Smallest capacity for a contiguous partition, by dynamic programming."""
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        following = best[:]
        for end in range(1, len(sizes) + 1):
            total = 0
            for start in range(end - 1, -1, -1):
                total += sizes[start]
                following[end] = min(following[end], max(best[start], total))
        best = following
    return best[-1]


@pytest.mark.parametrize("seed,shards", [(1, 8), (2, 3), (3, 1)])
def test_minimax_cuts(spark, seed, shards):
    rng = random.Random(seed)
    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([1, 5, 40, 300])) for i in range(60))
    capacity, cuts = minimax_cuts(spark.createDataFrame(groups, "digest string, bytes long"), shards)
    assert capacity == brute_capacity([b for _, b in groups], shards)
    sums = Counter()
    for d, b in groups:
        sums[sum(d >= c for c in cuts)] += b
    assert max(sums.values()) == capacity and len(cuts) < shards


def test_shards(make, corpus):
    out = shard_by_bytes(make(corpus)).collect()
    texts = dict(corpus)
    assert len(out) == len(corpus)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in out)
    for shard in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    place = {}
    for r in out:
        assert place.setdefault(texts[r["doc_id"]] or "", r["shard"]) == r["shard"]
    assert shard_by_bytes(make([])).count() == 0
    assert sorted(r["slot"] for r in shard_by_bytes(make([(1, None), (1, None), (None, "")])).collect()) == [0, 1, 2]


def test_mixing(make):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(3000)] + [(5000 + i, "n", "en", None) for i in range(300)]
    docs = make(rows)
    out = poisson_mix(docs, seed=4).collect()
    n = Counter(r["source"] for r in out)
    assert all(abs(n[s] - 1100) < 130 for s in ("big", "small", None))
    keys = [r["mix_key"] for r in out]
    assert keys == sorted(keys)
    copies = {}
    for r in out:
        copies.setdefault(r["doc_id"], []).append(r["mix_copy"])
        assert r["mix_copies"] >= 1
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in copies.values())
    # the counts of one source follow the Poisson distribution
    per = Counter(len(copies.get(i, [])) for i, *_ in rows if i < 3000 and i % 3)
    assert abs(per[0] / 2000 - math.exp(-0.55)) < 0.04 and abs(per[1] / 2000 - 0.55 * math.exp(-0.55)) < 0.04
    some = poisson_mix(docs, {"small": 1.0}, total=60000, seed=4).groupBy("source").count().collect()
    assert [r["source"] for r in some] == ["small"] and abs(some[0]["count"] - 60000) < 1200  # a rate of 60
    assert sorted(map(tuple, poisson_mix(docs, seed=4).select("doc_id", "mix_copy").collect())) == sorted((r["doc_id"], r["mix_copy"]) for r in out)
    assert poisson_mix(make([])).count() == 0


def test_mixing_edges(spark):
    rows = [(i if i % 10 else None, "t", f"s{i % 2}", "x", "x", "x") for i in range(400)] + [(7, "t", "s1", "x", "x", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, plan string, _plan string, mix_key string")
    for extra in (("plan", "_plan"), ("_src", "src"), ("_cdf", "cdf"), ("rate", "_rate")):
        named = docs.withColumnsRenamed(dict(zip(("plan", "_plan"), extra)))
        out = poisson_mix(named, seed=4)
        assert set(out.columns) == {*named.columns, "mix_rate", "mix_copies", "mix_copy"}
        found = out.collect()
        assert {r[extra[0]] for r in found} == {"x"} and all(isinstance(r["mix_key"], int) for r in found)
    copies = Counter(r["doc_id"] for r in found)
    assert copies[7] % 3 == 0 and copies[None] % 40 == 0  # equal ids, and rows without one, draw equal counts
    # many sources: those that are not hot are dealt by source
    wide = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "case when id < 1200 then 'hot' else cast(id as string) end as source")
    plain = poisson_mix(wide, seed=4).groupBy("source").agg(F.min("mix_rate").alias("r"), F.count("*").alias("n")).collect()
    assert {round(r["r"], 6) for r in plain if r["source"] == "hot"} == {round(4000 / 2801 / 1200, 6)}
    assert abs(sum(r["n"] for r in plain) - 4000) < 300


TEXTS = ["", None, "Hello  world's 12²\n\n \tx", "<|endoftext|>a<|endoftext|>", "漢字🙂 é  b", "a" * 3000, "ththe" * 800, " \x85\xa0 \n", "we'll they've I'm 'tis"]


def test_bpe(make):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("aàe 's'rlvé\n\t 12²漢🙂 \x85.,!AB|<>", k=rng.randint(1, 80))) for _ in range(300)]
    docs = make(list(enumerate(texts)) + [(3, TEXTS[3])])
    out = bpe_round_trip(docs, PATH).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(lib.decode(ids, skip_special_tokens=False))
    encoded = bpe_encode(docs, PATH)
    back = {r["doc_id"]: r["text"] for r in bpe_decode(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe_round_trip(make([]), PATH).count() == 0


def test_bpe_streams(monkeypatch):
    from tokenizers import Tokenizer

    from palimpsest.llm import bpe

    monkeypatch.setattr(bpe, "OPEN_WORD", 20)
    codec, lib = codec_of(open(PATH).read()), Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = [t for t in TEXTS if t] + ["".join(rng.choices("etaoin shr'\n<|>", k=6000)) for _ in range(5)]
    texts += ["".join(rng.choice(["e", " ", "\n", "'ve", "7", "!", "<|endoftext|>", "漢"]) * rng.choice([1, 2, 30, 90]) for _ in range(200)) for _ in range(20)]
    for text in texts:
        chunks, i = [], 0
        while i < len(text):
            k = rng.randint(1, 9)
            chunks.append(text[i : i + k])
            i += k
        want = lib.encode(text, add_special_tokens=False).ids
        assert [x for part in codec.encode_stream(chunks) for x in part] == want == codec.encode(text)
    assert codec.decode([codec.m.ids[b"\xc3"], codec.m.ids[b"a"]]) == b"\xc3a".decode("utf-8", "replace")
    assert codec.m.sufficient_lookahead() >= codec.m.longest


def test_bpe_splits_every_character_as_the_library():
    from tokenizers import pre_tokenizers

    from palimpsest.llm.bpe import split_words

    lib = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 50_000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n\n" for c in codes[at : at + 50_000])
        ends = [e for _, (_, e) in lib.pre_tokenize_str(text)]
        own, n = [], 0
        for w in split_words(text):
            n += len(w)
            own.append(n)
        assert own == ends


def test_bpe_memory_does_not_grow_with_the_text():
    codec = codec_of(open(PATH).read())

    def peak(pieces):
        tracemalloc.start()
        for _ in codec.encode_stream(f"ab{i % 7}" if mixed else "th" * 2000 for i in range(pieces)):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    for mixed, few in ((True, 30_000), (False, 50)):
        peak(few)
        assert peak(4 * few) < 1.5 * peak(few) + 100_000


def test_pipeline(spark, make, corpus, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_near

    docs = make([(i, t, "en", f"s{i % 3}") for i, t in corpus]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step, seen = docs, []
    for name, f in corpus_pipeline.STAGES:
        f(spark, step, str(tmp_path)).write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        seen.append(step)
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = {i for i, t in rows.items() if t and any(map(str.isalpha, t))}
    assert ids(seen[0]) == kept
    last = {}
    for i in sorted(kept):
        last[rows[i]] = i
    kept = set(last.values())
    assert ids(seen[1]) == kept
    near = brute_near([(i, rows[i]) for i in kept])
    kept = {i for i in kept if near[i][1] == i}
    assert ids(seen[2]) == kept
    assert ids(seen[3]) <= kept
    assert ids(seen[4]) == ids(seen[3]) and seen[4].count() == seen[3].count()
    want = sorted(map(tuple, seen[4].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_pipeline_decides_by_row(spark, tmp_path):
    """Rows without an id, repeated rows, rows that share an id, extra columns; and an empty table."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, rest string, key string"
    a, b = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    near = a + " more"
    build = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1, "x", "x", "x") for i, t in rows], schema)
    pairs = lambda df: sorted(((r["doc_id"] or -1, r["text"] or "") for r in df.collect()))

    rows = [(None, a), (None, "12 !"), (None, None), (1, a), (1, a), (1, b), (2, "")]
    out = stage["language_id"](spark, build(rows), "")
    assert out.columns == corpus_pipeline.COLUMNS and pairs(out) == sorted([(-1, a), (1, a), (1, a), (1, b)])
    rows = [(None, a), (1, a), (1, a), (5, a), (5, b), (5, b), (None, "x"), (None, "x"), (2, ""), (3, None)]
    out = stage["exact_dedup"](spark, build(rows), "")
    assert out.columns == corpus_pipeline.COLUMNS and pairs(out) == sorted([(5, a), (5, b), (-1, "x"), (3, "")])
    rows = [(None, near), (7, a), (7, near), (8, near + " x"), (9, b), (9, b + " y"), (4, b + " z"), (6, ""), (10, None)]
    out = stage["near_dedup"](spark, build(rows), "")
    assert out.columns == corpus_pipeline.COLUMNS and pairs(out) == sorted([(-1, near), (7, a), (4, b + " z"), (6, ""), (10, "")])
    empty = build([]).select(*corpus_pipeline.COLUMNS)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").count() == 0, name


def test_language_stage_heeds_the_label(spark, monkeypatch):
    import corpus_pipeline

    rows = [(i, ("the and of " if i % 2 else "ñe que ció ") * 20, "en" if i % 2 else "es", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ["es"])
    assert {r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {"es"}


def test_queries_and_oracles_agree_on_names():
    from palimpsest.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
