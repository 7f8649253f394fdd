"""Mixing sources to target weights by Poisson replication. DataFrame operations only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import HOT_SHARE

#: Rates above this are drawn as a sum of equal parts, so exp(-rate) stays far from underflow.
PART_RATE = 32.0
#: Rows of an output partition, at most about.
PART_ROWS = 100_000


def hashed(seed: int, *parts: Column) -> Column:
    """48 bits from an md5 of the seed and the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, 12), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(K <= k) for k = 0, 1, ... as an array, past any uniform number of 48 bits."""
    top = (F.ceil(rate + 12 * F.sqrt(rate)) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["c"])


def free_name(stem: str, taken: list[str]) -> str:
    """``stem`` with as many underscores before it as make it differ from all names in ``taken``, in either case."""
    taken = [t.lower() for t in taken]
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 20, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Repeat or leave out rows so that sources come in the given proportions; the columns of ``docs`` plus
    mix_rate, mix_copies, mix_copy (from 1) and mix_key, ordered by mix_key.

    The mean repetition rate of a source is total * weight / rows of the source. Each row's count is the inverse of
    the Poisson distribution at a uniform number hashed from the seed and its id, so a rerun or a lost executor
    gives the same rows. ``weights`` None: all sources weigh the same; a source without a weight gets none of the
    rows. A null source is a source of its own (key None). ``total`` None: as many as the input, on average. Equal
    ids draw equal counts, and so do all rows without an id. Columns of ``docs`` named mix_rate, mix_copies, mix_copy or
    mix_key give way to the new ones; any other names may occur. Empty in, empty out.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    plan_name = free_name("plan", docs.columns)
    counts = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    sums = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    goal = F.lit(float(total)) if total is not None else sums.select("n").scalar().cast("double")
    rate = F.when(F.col("w") > 0, goal * F.col("w") / sums.select("w").scalar() / F.col("n")).otherwise(F.lit(0.0))
    rates = counts.select("src", "n", rate.alias("rate")).where("rate > 0").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    plan = rates.select("n", F.struct("src", "rate", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf")).alias(plan_name))
    src = F.col(plan_name)["src"]

    def draw(acc: Column, j: Column) -> Column:
        u = (hashed(seed, F.col(id_col), j) + F.lit(0.5)) / F.lit(float(1 << 48))
        return acc + F.size(F.filter(F.col(plan_name)["cdf"], lambda c: c < u))

    # hot sources, more than one row in HOT_SHARE, are at most HOT_SHARE: their plans are broadcast; the rest goes by source
    sizes = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).first()
    limit = (sizes["n"] or 0) // HOT_SHARE if sizes["m"] > HOT_SHARE else 0
    marked = docs.join(F.broadcast(plan.where(F.col("n") > limit).select(plan_name)), F.col(source_col).eqNullSafe(src), "left")
    rows = marked.where(F.col(plan_name).isNotNull())
    if limit:
        rest = marked.where(F.col(plan_name).isNull()).drop(plan_name)
        rows = rows.unionByName(rest.join(plan.where(F.col("n") <= limit).select(plan_name), F.col(source_col).eqNullSafe(src)))
    rows = rows.withColumn("mix_copies", F.aggregate(F.sequence(F.lit(1), F.col(plan_name)["parts"]), F.lit(0), draw)).where("mix_copies > 0")
    rows = rows.withColumn("mix_rate", F.col(plan_name)["rate"]).drop(plan_name)
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    rows = rows.withColumn("mix_key", hashed(seed + 1, F.col(id_col), F.col("mix_copy")))
    # keys are uniform over 48 bits, so equal ranges of keys are parts of equal size: a total order without a pass that samples
    wanted = float(total) if total is not None else float(sizes["n"] or 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(wanted / PART_ROWS))
    part = F.floor(F.col("mix_key") / F.lit(float(1 << 48)) * F.lit(parts)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("mix_key", id_col, "mix_copy")
