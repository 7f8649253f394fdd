"""Exact dedup with a log-structured merge index of text digests. DataFrame operations only.

* Rows go into MEMTABLES memtables by scan task. A memtable is flushed as a run: one entry (digest, id that stays, rows) per
  digest, sorted by digest, with Parquet Bloom filters for point lookups and a bitmap of a bounded number of bits.
* Compaction merges the runs of a level into one run of the next. The bits that two runs have in common are one bitmap; an
  entry whose bit is not among them is in no other run and passes as it is. Only the others are dealt by digest and merged, keeping the smallest (largest) id. A level that
  has gathered FANOUT runs is compacted; reading compacts what is left.
* Digests with more than one row are hits. A bitmap of a bounded number of bits over the hits keeps the text of other
  rows from moving; texts of hits are then compared byte by byte (smallest against largest text of a digest, a
  partial aggregate, so a hot group is combined before it is shuffled). Rows of a digest that holds different texts
  are grouped again by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import join_counted, new_path

#: Most bits of a bitmap over digests: 1 MB, whatever the input.
MAX_FILTER_BITS = 1 << 23
#: Runs that one insert flushes; runs of a level that are merged into one of the next.
MEMTABLES, FANOUT = 8, 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filter_bits(n: int) -> int:
    """Bits of a bitmap over n digests: 16 or more for each, as long as the bound allows it."""
    return min(MAX_FILTER_BITS, 1 << max(13, ceil(log2(16 * n + 1))))


def _word(value: Column, bits: int) -> tuple[Column, Column]:
    """(which word of a bitmap, which bit of the word) stand for a value."""
    slot = F.pmod(F.xxhash64(value), F.lit(bits)).cast("int")
    return F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")


def _words(rows: DataFrame, value: str, bits: int, *by: str) -> DataFrame:
    """(by, w, b): the words of the bitmaps of the values of each group that have a bit."""
    w, bit = _word(F.col(value), bits)
    return rows.select(*by, w.cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy(*by, "w").agg(F.bit_or("b").alias("b"))


def _array(words: DataFrame, bits: int) -> DataFrame:
    """One row, ``bitmap`` array<long>, from the words (w, b) that have a bit; the others are 0."""
    blank = words.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = words.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bitmap"))


def bitmap(rows: DataFrame, value: str, bits: int) -> DataFrame:
    return _array(_words(rows, value, bits), bits)


def shared_bitmap(rows: DataFrame, value: str, bits: int, by: str) -> DataFrame:
    """The bits that are set in the bitmaps of two groups or more: what a probe of each group's against all others' finds."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("twice"))

    def add(acc: Column, b: Column) -> Column:
        return F.struct(acc["seen"].bitwiseOR(b).alias("seen"), acc["twice"].bitwiseOR(acc["seen"].bitwiseAND(b)).alias("twice"))

    twice = F.aggregate(F.collect_list("b"), start, add, lambda acc: acc["twice"])  # a word per group
    return _array(_words(rows, value, bits, by).groupBy("w").agg(twice.alias("b")), bits)


def has_bit(bitmap: Column, value: Column, bits: int) -> Column:
    w, bit = _word(value, bits)
    return F.call_function("shiftrightunsigned", F.element_at(bitmap, w + 1), bit).bitwiseAND(F.lit(1).cast("long")) == 1


class DigestIndex:
    """Rows (doc_id, digest) as they came, and levels of runs of entries (digest, keep_id, n)."""

    def __init__(self, spark: SparkSession, keep: str = "min", digest: Callable[[Column], Column] = sha256, fanout: int = FANOUT):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.digest, self.fanout = spark, digest, fanout
        self.best = F.min if keep == "min" else F.max
        self.logs: list[DataFrame] = []
        self.levels: list[list[tuple[DataFrame, int]]] = [[]]  # of a level: tables (run, digest, keep_id, n) and their numbers of runs

    def _write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = new_path(self.spark, name)
        (
            df.sortWithinPartitions(*by, "digest")
            .write.partitionBy(*by)
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "100000")
            .parquet(path)
        )
        return self.spark.read.schema(df.schema).parquet(path)

    def insert(self, docs: DataFrame, log: bool = True) -> None:
        """Flush the memtables of a batch ``docs`` (doc_id, text) as runs of level 0. Without ``log``, rows() leaves the batch
        out and no table of its rows is written."""
        rows = docs.select("doc_id", self.digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)).alias("run"))
        if log:
            path = new_path(self.spark, "lsm-log")
            rows.write.parquet(path)
            rows = self.spark.read.schema(rows.schema).parquet(path)
            self.logs.append(rows.select("doc_id", "digest"))
        runs = self._write(rows.groupBy("run", "digest").agg(self.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "lsm-l0", "run")
        present = runs.select("run").distinct().count()
        self.levels[0].append((runs, present))
        level = 0
        while sum(k for _, k in self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def rows(self) -> DataFrame:
        """Every (doc_id, digest) inserted with a log so far."""
        return reduce(DataFrame.unionByName, self.logs)

    def _merged(self, runs: list[tuple[DataFrame, int]]) -> DataFrame:
        """One entry per digest of the runs."""
        tagged = reduce(DataFrame.unionByName, [r.withColumn("run", F.col("run") + i * (MEMTABLES + 1)) for i, (r, _) in enumerate(runs)])
        n = tagged.count()
        bits = filter_bits(n)
        if bits < 4 * n:  # a bitmap of bounded size would be full of ones
            shared, alone = tagged, tagged.limit(0)
        else:
            probe = has_bit(shared_bitmap(tagged, "digest", bits, "run").scalar(), F.col("digest"), bits)
            shared, alone = tagged.where(probe), tagged.where(~probe)
        merged = shared.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return merged.unionByName(alone.select(*merged.columns))

    def _compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next."""
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append((self._write(self._merged(self.levels[level]).withColumn("run", F.lit(0)), f"lsm-l{level + 1}"), 1))
        self.levels[level] = []

    def entries(self) -> DataFrame:
        """(digest, keep_id, n) over everything inserted, as one run."""
        runs = [r for level in self.levels for r in level]
        if sum(k for _, k in runs) > 1:
            runs = [(self._write(self._merged(runs).withColumn("run", F.lit(0)), "lsm-all"), 1)]
            self.levels = [*([] for _ in self.levels), runs]
        return runs[0][0].select("digest", "keep_id", "n")

    def contains(self, digests: list[bytes]) -> DataFrame:
        """Point lookups: the runs' Bloom filters let row groups without the digest be skipped."""
        return self.entries().where(F.col("digest").isin([bytearray(d) for d in digests]))


def hit_filter(hits: DataFrame, n_hits: int, column: str = "digest") -> Callable[[Column], Column]:
    """A test that no value among ``hits`` fails, from one bitmap of at most MAX_FILTER_BITS bits."""
    bits = filter_bits(n_hits)
    found = bitmap(hits, column, bits)
    return lambda value: has_bit(found.scalar(), value, bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the row with the smallest
    (``keep='max'``: largest) id stays. Null ids lose against others; in a group of null ids keep_id is null and all
    stay. Repeated rows (equal id and text) share one decision. An empty table gives an empty result. Further columns
    are ignored, whatever their names. ``digest`` may be any function of the text: rows of one digest are compared as bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    index = DigestIndex(spark, keep, digest)
    index.insert(docs)
    hits = index.entries().where("n > 1")
    rows = index.rows()
    decided = join_counted(rows, hits.withColumnsRenamed({"keep_id": "k"}), "digest", rows.count(), "n").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "digest"
    )
    n_hits = hits.count()
    if n_hits:
        keyed = docs.withColumn("digest", digest(F.col("text")))
        maybe = keyed.where(hit_filter(hits, n_hits)(F.col("digest")))
        seen = maybe.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        path = new_path(spark, "lsm-unequal")
        seen.where(F.col("lo") != F.col("hi")).select("digest").write.parquet(path)
        unequal = spark.read.schema("digest binary" if dict(seen.dtypes)["digest"] == "binary" else f"digest {dict(seen.dtypes)['digest']}").parquet(path)
        if not unequal.isEmpty():  # different texts under one digest: group by the text itself
            best = F.min if keep == "min" else F.max
            apart = keyed.join(unequal, "digest", "left_semi")
            groups = apart.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            decided = decided.join(unequal, "digest", "left_anti").unionByName(apart.join(groups, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "digest"))
    return decided.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` without copies: of equal texts (null as empty) the row with the smallest (``keep='max'``:
    largest) id, whole and once. Rows without an id lose against others; among equal ids, or none, the order of
    the other columns decides. An empty table gives an empty result.

    Texts whose digest the index has once pass without a shuffle; the others are grouped by the text itself."""
    index = DigestIndex(docs.sparkSession, keep, digest)
    text = F.coalesce(F.col(text_col), F.lit(""))
    index.insert(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), log=False)
    hits = index.entries().where("n > 1")
    maybe = hit_filter(hits, hits.count())(digest(text))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("no_text"), F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), row.alias("row"))) if keep == "min" else F.max(F.struct(F.col(id_col).isNotNull().alias("no_id"), row.alias("row")))
    one = docs.where(maybe).groupBy(text.alias("key")).agg(first["row"].alias("row"))
    columns = {id_col: F.col("row")["id"], text_col: F.when(~F.col("row")["no_text"], F.col("key"))} | {c: F.col("row")["rest"][c] for c in rest}
    return docs.where(~maybe).unionByName(one.select(*[columns[c].alias(c) for c in docs.columns]))
