"""Adapters from stored tables to layout blocks, and an optional PDF scan.

A blocks table has pair_id, doc_side ('legacy' or 'modern'), page, block_pos, text, x0, y0, x1, y1, font_size, is_bold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions.text import normalize_text
from palimpsest.plans.staging import staged

BLOCKS = "pair_id string, doc_side string, page int, block_pos int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean"
LINES_PER_PAGE = 4


def _based(documents: DataFrame) -> DataFrame:
    """Documents that have a text, with its digest and ``base``, the id as text; rows without an id are named by their text."""
    d = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return d.withColumn("base", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), "digest")))


def _numbered(based: DataFrame) -> DataFrame:
    """Adds ``copy``, the number of a row among those of its base."""
    return based.withColumn("copy", F.row_number().over(W.partitionBy("base").orderBy("digest")))


def _name() -> Column:
    return F.when(F.col("copy") == 1, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("copy").cast("string")))


def named_documents(documents: DataFrame) -> DataFrame:
    """(name, doc_id, lines) of every document that has a text. A name is the id as text; rows without an id are named by
    their text, and further rows of one name get a number."""
    return _numbered(_based(documents)).select(_name().alias("name"), "doc_id", F.split("text", "\n").alias("lines"))


def predecessors(named: DataFrame) -> DataFrame:
    """(before, name): documents of one first line in the order of their ids, each with the one before it."""
    return _linked(named.select(F.sha2(F.element_at("lines", 1), 256).alias("key"), "doc_id", "name")).select(F.col("last.name").alias("before"), "name")


def _linked(keyed: DataFrame) -> DataFrame:
    """Rows of (key, doc_id, name, more) that have one of their key before them, with that one as ``last``.

    Rows are dealt by ranges of (first line, id), so a group of any size spreads over tasks; only the last row of a range
    is handed to the next."""
    order = ["key", "doc_id", "name"]
    row = F.struct(*order, *[c for c in keyed.columns if c not in order])
    d = staged(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "first-lines")
    ends = d.groupBy("part").agg(F.max(row).alias("end"))  # one row per range
    ends = ends.select("part", F.lag("end").over(W.orderBy("part")).alias("end"))
    within = F.lag(row).over(W.partitionBy("part").orderBy(*order))
    d = d.withColumn("last", within).join(F.broadcast(ends), "part").withColumn("last", F.coalesce("last", "end"))
    return d.where(F.col("last.key") == F.col("key"))


def linked_texts(documents: DataFrame) -> DataFrame:
    """(name, text, before, followed) of the documents in document_pairs(), each once: ``before`` is the name of the legacy
    side of the pair whose modern side it is, if any, and ``followed`` tells whether it is the legacy side of one.

    Pairs are found without the texts, and texts move once, those of documents without a partner no further."""
    based = _based(documents)
    names = _numbered(based.select("doc_id", "digest", "base", F.sha2(F.substring_index("text", "\n", 1), 256).alias("key")))
    links = staged(_linked(names.select("key", "doc_id", _name().alias("name"), "base", "digest")).select("last", "name", "base", "digest"), "document-links")
    modern = links.select("name", "base", "digest", F.col("last.name").alias("before"), F.lit(False).alias("followed"))
    legacy = links.select("last.name", "last.base", "last.digest", F.lit(None).cast("string").alias("before"), F.lit(True).alias("followed"))
    roles = modern.unionByName(legacy).groupBy("name", "base", "digest").agg(F.max("before").alias("before"), F.bool_or("followed").alias("followed"))
    # rows that are alike in id and text differ in their numbers only: one of them serves for all
    first = F.lag(F.lit(1)).over(W.partitionBy("base", "digest").orderBy("digest")).isNull()
    texts = based.select("text", "digest", "base").withColumn("first", first).where("first")
    return texts.join(roles, ["base", "digest"]).select("name", "text", "before", "followed")


def document_pairs(documents: DataFrame) -> DataFrame:
    """(pair_id, doc_side, doc_id, lines): every document that shares its first line with one of a smaller id is the
    modern side of a pair, the one next before it the legacy side, whose name is the pair's id."""
    named = named_documents(documents)
    links = staged(predecessors(named), "document-links")
    legacy, modern = links.select(F.col("before").alias("name"), F.col("before").alias("pair_id")), links.select("name", F.col("before").alias("pair_id"))
    out = [named.join(x, "name").select("pair_id", F.lit(side).alias("doc_side"), "doc_id", "lines") for side, x in (("legacy", legacy), ("modern", modern))]
    return out[0].unionByName(out[1])


def single_documents(documents: DataFrame) -> DataFrame:
    """(pair_id, doc_side, doc_id, lines): every document by itself, as the legacy side of a pair of its name."""
    return named_documents(documents).select(F.col("name").alias("pair_id"), F.lit("legacy").alias("doc_side"), "doc_id", "lines")


def small_group_pairs(documents: DataFrame) -> DataFrame:
    """The part of document_pairs() that the DuckDB equivalents are written for, not the whole: documents of three lines
    or more that share their first line with one to three others, and of those the two smallest ids."""
    d = documents.select("doc_id", F.split("text", "\n").alias("lines")).where(F.size("lines") >= 3).withColumn("key", F.element_at("lines", 1))
    w = W.partitionBy("key")
    few = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n between 2 and 4").select("key", "first")
    d = d.join(few, "key").withColumn("r", F.row_number().over(w.orderBy("doc_id"))).where("r <= 2")
    return d.select(F.col("first").cast("string").alias("pair_id"), F.when(F.col("r") == 1, "legacy").otherwise("modern").alias("doc_side"), "doc_id", "lines")


def document_blocks(documents: DataFrame, pitch: bool = False, pairs: Callable[[DataFrame], DataFrame] = document_pairs) -> DataFrame:
    """One block per line of ``pairs`` of the documents. ``pitch``: lines whose number is no multiple of 3 follow closely."""
    lines = pairs(documents).select("pair_id", "doc_side", F.posexplode("lines").alias("line", "text"))
    at = F.col("line") % LINES_PER_PAGE
    y0 = (at * 40 - F.when(F.col("line") % 3 != 0, 26).otherwise(0) if pitch else at * 40).cast("double")
    return lines.select(
        "pair_id", "doc_side", (F.floor(F.col("line") / LINES_PER_PAGE) + 1).cast("int").alias("page"), at.alias("block_pos"), "text",
        F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(550.0).alias("x1"), (y0 + 12).alias("y1"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """Web pages as pages of one document per language: even page_ids are the legacy side, odd ones the modern side.

    h1 is large and bold, li gets a bullet; scripts, styles and comments are left out."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    html = F.regexp_replace(html, r"<(h1|p|li)(?: [^>]*)?>", "\x01$1\x02")
    html = F.regexp_replace(F.regexp_replace(html, r"</(h1|p|li|ul|nav|article|div|footer)>", "\x01"), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    # all of a page's text is worked on before pages are numbered, which goes through one task per language and side
    parts = F.filter(F.split(html, "\x01"), lambda x: x.rlike("(?s)^(h1|p|li)\x02"))
    parts = F.transform(parts, lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("tag"), normalize_text(F.substring_index(x, "\x02", -1)).alias("t")))
    side = F.when(F.col("page_id") % 2 == 0, "legacy").otherwise("modern")
    p = pages.select(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("pair_id"), side.alias("doc_side"), "page_id", F.filter(parts, lambda x: x["t"] != "").alias("parts"))
    p = p.where("pair_id <> ''").withColumn("page", F.row_number().over(W.partitionBy("pair_id", "doc_side").orderBy("page_id")))
    b = p.select("pair_id", "doc_side", "page", F.posexplode("parts").alias("block_pos", "part")).select("pair_id", "doc_side", "page", "block_pos", "part.*")
    y0, large = (F.col("block_pos") * 40).cast("double"), F.col("tag") == "h1"
    return b.select(
        "pair_id", "doc_side", "page", "block_pos", F.when(F.col("tag") == "li", F.concat(F.lit("• "), F.col("t"))).otherwise(F.col("t")).alias("text"),
        F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(550.0).alias("x1"), (y0 + 12).alias("y1"), F.when(large, 18.0).otherwise(10.0).alias("font_size"), large.alias("is_bold"),
    )


def pdf_blocks(spark: SparkSession, path: str, pair_id: str, doc_side: str) -> DataFrame:
    """Blocks of PDF files. Needs PyMuPDF on the executors."""

    def run(batches):
        import fitz
        import pandas as pd

        for files in batches:
            rows = []
            for content in files["content"]:
                for page in fitz.open(stream=bytes(content), filetype="pdf"):
                    for pos, block in enumerate(b for b in page.get_text("dict", sort=True)["blocks"] if b["type"] == 0):
                        spans = [s for line in block["lines"] for s in line["spans"]]
                        text = "\n".join("".join(s["text"] for s in line["spans"]) for line in block["lines"])
                        if spans and text.strip():
                            rows.append((pair_id, doc_side, page.number + 1, pos, text, *map(float, block["bbox"]), max(float(s["size"]) for s in spans), any(s["flags"] & 16 for s in spans)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, BLOCKS).withColumn("text", normalize_text(F.col("text"))).where("text <> ''")


def page_counts(blocks: DataFrame) -> DataFrame:
    """(pair_id, doc_side, page_count) where no document table says it: the last page that has a block."""
    return blocks.groupBy("pair_id", "doc_side").agg(F.max("page").alias("page_count"))
