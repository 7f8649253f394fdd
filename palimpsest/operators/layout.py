"""Layout operators over blocks: repeated headers, the median font, wrapped paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions.text import header_candidate, is_bullet, is_heading, normalize_text

SIDE = ["pair_id", "doc_side"]
#: Fixed tolerances of merging, and the share of pages (and least number) that makes a line a header or footer.
INDENT, GAP = 28.0, 18.0
SHARE, LEAST = 0.35, 2


def repeated_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, doc_side, key) of lines that stand on many pages of a document."""
    key = F.lower(normalize_text(F.col("text")))
    seen = blocks.withColumn("key", key).where(header_candidate(F.col("key"))).groupBy(*SIDE, "key").agg(F.countDistinct("page").alias("n"))
    return seen.join(pages, SIDE).where(F.col("n") >= F.greatest(F.lit(LEAST), F.floor(F.greatest("page_count", F.lit(1)) * SHARE))).select(*SIDE, "key")


def drop_repeated_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.withColumn("key", F.lower(normalize_text(F.col("text")))).join(repeated_headers(blocks, pages), [*SIDE, "key"], "left_anti").drop("key").select(*blocks.columns)


def median_font(blocks: DataFrame) -> DataFrame:
    """(pair_id, doc_side, median): of n positive sizes the one at place n // 2, from 0; 0 if there are none.

    Sizes are counted first, so what is sorted per document is its few distinct sizes."""
    sizes = blocks.where("font_size > 0").groupBy(*SIDE, "font_size").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*SIDE)
    upto = sizes.withColumn("upto", F.sum("n").over(w.orderBy("font_size"))).withColumn("total", F.sum("n").over(w))
    found = upto.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*SIDE).agg(F.min("font_size").alias("median"))
    return blocks.select(*SIDE).distinct().join(found, SIDE, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))


def merge_blocks(blocks: DataFrame, medians: DataFrame) -> DataFrame:
    """Join the lines of wrapped paragraphs; headings and bullets stay on their own.

    Columns as blocks; block_pos numbers the merged blocks of a page."""
    b = blocks.join(medians, SIDE).withColumn("t", normalize_text(F.col("text"))).where("t <> ''")
    b = b.withColumn("alone", is_heading(F.col("t"), F.col("font_size"), F.col("is_bold"), F.col("median"), True) | is_bullet(F.col("t"), True))
    page = W.partitionBy(*SIDE, "page").orderBy(F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), "block_pos")
    apart = (F.abs(F.lag("x0").over(page) - F.col("x0")) > INDENT) | (F.col("y0") - F.lag("y1").over(page) > GAP)
    opens = F.col("alone") | F.coalesce(F.lag("alone").over(page), F.lit(True)) | F.coalesce(apart, F.lit(False))
    b = b.withColumn("rn", F.row_number().over(page)).withColumn("island", F.sum(opens.cast("int")).over(page))
    # a hyphen at the end of a line joins it with the next one
    piece = F.when(F.col("t").endswith("-"), F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.concat("t", F.lit(" ")))
    b = b.withColumn("piece", piece)
    parts = F.sort_array(F.collect_list(F.struct("rn", "piece", "t")))
    last = F.element_at(parts, -1)
    joined = F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x["piece"]), ""), last["t"])
    merged = b.groupBy(*SIDE, "page", "island").agg(
        F.when(F.first("alone"), F.first("text")).otherwise(normalize_text(joined)).alias("text"),
        *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
        F.max("font_size").alias("font_size"),
        F.bool_or("is_bold").alias("is_bold"),
        F.first("median").alias("median"),
    )
    return merged.where("text <> ''").withColumn("block_pos", F.col("island") - 1).drop("island")


def union_boxes(blocks: DataFrame, *keys: str) -> DataFrame:
    """Bounding box per group; blocks without one don't count."""
    return blocks.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
