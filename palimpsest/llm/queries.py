"""The registered queries opN_<name> and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, language_id, toxicity
from palimpsest.llm.bpe import bpe_round_trip
from palimpsest.llm.common import held_out
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.mixing import poisson_mix
from palimpsest.llm.ngram_join import ngram_join
from palimpsest.llm.secret_scan import corpus_words, find_secrets, train
from palimpsest.llm.sharding import shard_by_bytes
from palimpsest.llm.substring_dedup import remove_repeated_windows

MIX_SEED = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, train(corpus_words(docs)))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.filter("spans", lambda x: x["kind"] != "markov")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), n=5, percent=75)


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix(documents(spark, sf_dir), seed=MIX_SEED)
    return out.withColumn("mix_rate", F.round("mix_rate", 9))


def op9_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_markov_secrets": op1_markov_secrets,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_gru_language": op3_byte_gru_language,
    "op4_count_min_substrings": op4_count_min_substrings,
    "op5_minimax_shards": op5_minimax_shards,
    "op6_ngram_rtree": op6_ngram_rtree,
    "op7_ivf_pq": op7_ivf_pq,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_gru_toxicity": op9_gru_toxicity,
    "op10_bpe": op10_bpe,
}

_HASHED = "('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '~') || ':' || {part}), 1, 12))::bigint"

_WORD = r"'[^\x20\x09-\x0D]+'"

#: CRC-32 of the bytes of t, by the table of its polynomial.
_CRC_BIT = "case when {c} % 2 = 1 then xor({c} // 2, 3988292384) else {c} // 2 end"
_CRC_TABLE = f"select list(c order by n) as crc from (with recursive r as (select n, n::bigint as c, 0 as k from range(256) as x(n) union all select n, {_CRC_BIT.format(c='c')}, k + 1 from r where k < 8) select n, c from r where k = 8)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(t)) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)), lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295::bigint)"

ORACLES: dict[str, str] = {
    # slots as they are where no part of the digest order has more than CELL_ROWS rows
    "op5_minimax_shards": f"""
        with recursive d as (select doc_id, coalesce(text, '') as t from documents),
        rows_of as (select doc_id, t, hex(encode(t)) as h, octet_length(encode(t)) + 1 as size, sha256(t) as digest from d),
        groups as (select digest, bytes, (sum(bytes) over (order by digest))::bigint as upto from (select digest, sum(size)::bigint as bytes from rows_of group by digest)),
        sums as (select list(upto order by upto) as ends, max(upto) as total, max(bytes) as largest from groups),
        search as (
            select greatest(largest, (total + 7) // 8) as low, total // 8 + largest + 1 as high, 0 as s, 0::bigint as reached from sums
            union all
            select case when s < 8 or reached >= total then low else (low + high) // 2 + 1 end, case when s = 8 and reached >= total then (low + high) // 2 else high end,
                   case when s < 8 then s + 1 else 0 end, case when s < 8 then list_max(list_filter(ends, lambda x: x <= reached + (low + high) // 2)) else 0 end
            from search, sums where low < high),
        capacity as (select min(low) as c from search where low = high),
        cuts as (
            select 0 as s, 0::bigint as reached from capacity
            union all select s + 1, list_max(list_filter(ends, lambda x: x <= reached + c)) from cuts, capacity, sums where s < 8),
        shards as (select digest, count(*) filter (reached < upto) - 1 as shard from groups, cuts group by digest),
        table_of as ({_CRC_TABLE})
        select doc_id, size::bigint as size, {_CRC} as text_crc32, 'bytes' as law, shard::int as shard,
               row_number() over (partition by shard order by digest, doc_id nulls first) - 1 as slot, null::int as grown_shard
        from rows_of join shards using (digest), table_of""",
    "op4_count_min_substrings": f"""
        with w as (select doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) as words from documents),
        windows as (select doc_id, i, words[i:i + 12] as win from (select *, unnest(range(1, len(words) - 11)) as i from w)),
        firsts as (select win, min(doc_id) as first from windows group by win),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (win) where first < doc_id),
        each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from w),
        kept as (select doc_id, string_agg(word, ' ' order by p) as t from each anti join gone using (doc_id, p) group by doc_id),
        removed as (select doc_id, count(*) as n from gone group by doc_id)
        select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join kept using (doc_id) left join removed using (doc_id)""",
    "op6_ngram_rtree": f"""
        with recursive w as (
            select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}), []) as words from documents),
        sets as (
            select doc_id, unnest(list_distinct(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                                     when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as s from w),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b using (s) where a.doc_id <> b.doc_id group by all),
        links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
        reach as (select doc_id, doc_id as r from documents union select reach.doc_id, y from reach join links on r = x),
        lowest as (select doc_id, min(r) as component_id from reach group by doc_id),
        degree as (select x as doc_id, count(*) as n_links from links group by x)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
        from lowest left join sizes using (doc_id) left join degree using (doc_id)""",
    "op2_exact_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window g as (partition by coalesce(text, ''))""",
    "op8_poisson_mix": f"""
        with n as (select source, count(*) as n from documents group by source),
        rates as (select source, (select count(*) from documents)::double / (select count(*) from n) / n as rate from n),
        cdf as (
            select source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as c
            from rates, generate_series(0, 200) as s(k) where k <= ceil(rate + 12 * sqrt(rate)) + 24),
        drawn as (
            select d.*, ({_HASHED.format(seed=MIX_SEED, part="'1'")} + 0.5) / 281474976710656.0 as u from documents d),
        counted as (
            select doc_id, text, lang, d.source, n_chars, rate, (select count(*) from cdf c where c.source = d.source and c.c < u) as copies
            from drawn d join rates r on d.source = r.source)
        select doc_id, text, lang, source, n_chars, round(rate, 9) as mix_rate, copies::int as mix_copies, j::int as mix_copy,
               {_HASHED.format(seed=MIX_SEED + 1, part="j")} as mix_key
        from counted, lateral (select unnest(generate_series(1, copies)) as j)""",
}
