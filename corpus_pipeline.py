"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenizing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; further columns of ``documents`` are left out.
Stages pass on the rows they keep, not ids. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language_id
from palimpsest.llm.bpe import bpe_round_trip
from palimpsest.llm.common import scratch, staged
from palimpsest.llm.exact_dedup import without_copies
from palimpsest.llm.mixing import poisson_mix
from palimpsest.llm.ngram_join import without_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
MIX_SEED = 20
#: Languages that stay (None: all that were learnt), and the least mean probability of the likeliest one.
LANGUAGES: list[str] | None = None
LEAST_SHARE = 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likeliest language is among LANGUAGES (None: any that was learnt) with a mean probability of
    LEAST_SHARE or more; those without text or letters (``und``) go. Rows are decided on one by one."""
    labelled = language_id.identify(docs, language_id.train(docs), whole=True)
    wanted = F.col("lang_pred") != "und" if LANGUAGES is None else F.col("lang_pred").isin(LANGUAGES)
    return labelled.where(wanted & (F.col("score") >= LEAST_SHARE)).select("row.*").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest id; rows without an id lose against others."""
    return without_copies(docs, keep="max").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row, that with the smallest id (five words, similarity 0.75 or more). Rows
    without an id stay."""
    return without_near_copies(docs, n=5, percent=75).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal parts, rows repeated or left out by their Poisson counts, in shuffled order."""
    return poisson_mix(docs, seed=MIX_SEED).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Language ID and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
