"""Sharding by a minimax contiguous partition of atomic groups.

Groups of equal texts are ordered by the digest of the text. The smallest capacity under which a greedy sweep needs no
more than the wanted number of shards is found by binary search; the sweep's cuts are digests, so placing a row is a
comparison with at most shards - 1 constants. The sweep works on sums under prefixes of the digest: the first level
has PREFIX hex digits and each look below a prefix fetches another level of at most 16 ** PREFIX sums, so the driver
holds a bounded number of sums however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.llm.common import staged

PREFIX = 3
#: Rows of a cell, about: slots are counted by cells, so a text with very many copies is spread.
CELL_ROWS = 1 << 16


class GroupSums:
    """Prefix sums of group sizes in digest order, fetched level by level."""

    def __init__(self, groups: DataFrame):
        self.groups, self.levels = groups, {}
        self.top = self.level("")
        self.total = self.top[1][-1] if self.top[1] else 0

    def level(self, prefix: str) -> tuple[list[str], list[int], list[int]]:
        """Below ``prefix``: digest parts in order, running sums of bytes, groups in each."""
        if prefix not in self.levels:
            part = F.substring("digest", 1 + len(prefix), PREFIX)
            at = F.col("digest") >= prefix, F.col("digest") < prefix + "g"
            rows = sorted(tuple(r) for r in self.groups.where(at[0] & at[1]).groupBy(part).agg(F.sum("bytes"), F.count(F.lit(1))).collect())
            self.levels[prefix] = [r[0] for r in rows], list(accumulate(r[1] for r in rows)), [r[2] for r in rows]
        return self.levels[prefix]

    def cut(self, limit: int) -> tuple[int, str | None]:
        """The largest sum of leading groups within ``limit``, and the digest prefix at which the next group starts."""
        prefix, before = "", 0
        while True:
            parts, sums, groups = self.level(prefix)
            i = bisect_right(sums, limit - before)
            if i == len(parts):
                return before + (sums[-1] if sums else 0), None
            below = sums[i - 1] if i else 0
            if groups[i] == 1 or len(prefix) + PREFIX >= 64:
                return before + below, prefix + parts[i]
            prefix, before = prefix + parts[i], before + below

    def bounds(self, capacity: int, shards: int) -> bool | None:
        """Whether the capacity suffices, from the first level alone; None where it can't tell."""
        low = high = 0
        sums = self.top[1]
        for _ in range(shards):
            i = bisect_right(sums, low + capacity)
            low, high = max(low, sums[i - 1] if i else 0), high + capacity
        return True if low >= self.total else False if high < self.total else None

    def sweep(self, capacity: int, shards: int) -> list[str] | None:
        """Cuts of the greedy sweep, or None if it needs more shards."""
        at, cuts = 0, []
        for _ in range(shards):
            at, following = self.cut(at + capacity)
            if following is None:
                return cuts
            cuts.append(following)
        return None


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, digest prefixes at which shards 1, 2, ... start) of ``groups`` (digest, bytes)."""
    sums = GroupSums(groups)
    if not sums.total:
        return 0, []
    largest = groups.agg(F.max("bytes")).first()[0]
    low, high = max(largest, -(-sums.total // shards)), sums.total // shards + largest + 1
    while low < high:
        middle = (low + high) // 2
        fits = sums.bounds(middle, shards)
        if fits is None:
            fits = sums.sweep(middle, shards) is not None
        low, high = (low, middle) if fits else (middle + 1, high)
    return low, sums.sweep(low, shards)


def place(digest: Column, cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (digest >= c).cast("int")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 1 (null: as empty). Rows of equal texts share a shard; the largest shard
    is as small as any cut of the digest order allows. Slots run from 0 without gaps in each shard. Repeated rows count
    and are placed each; rows without an id are rows like others. Columns besides the two are ignored. Fewer groups than shards leave shards empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    rows = staged(rows.withColumn("spread", F.xxhash64("doc_id", F.monotonically_increasing_id())), "shard-rows")
    sums = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = staged(sums.repartitionByRange("digest").sortWithinPartitions("digest"), "shard-groups")  # so that looks below a prefix skip files
    _, cuts = minimax_cuts(groups, shards)
    rows = rows.withColumn("shard", place(F.col("digest"), cuts)).withColumn("part", F.substring("digest", 1, PREFIX))
    parts = rows.groupBy("shard", "part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("cells"))
    rows = rows.join(F.broadcast(parts), ["shard", "part"]).withColumn("cell", F.pmod("spread", "cells"))  # 16 ** PREFIX + shards rows at most
    key = ["shard", "part", "cell"]
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))  # about a row per CELL_ROWS rows, and per part
    cells = cells.select(*key, (F.sum("n").over(W.partitionBy("shard").orderBy("part", "cell")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("digest", "doc_id")))
    return numbered.join(cells, key).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("k") - 1).alias("slot"))
