"""From blocks to the nodes of document trees: headings, paths, capped chunks, ids, parents, leaf order.

Every step is a window or an aggregate over one document side or page, so any number of document pairs runs in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as T
from palimpsest.operators.layout import SIDE, drop_repeated_headers, median_font, merge_blocks
from palimpsest.plans.staging import staged

NODE_COLUMNS = [*SIDE, "node_id", "page", "kind", "path", "text", "parent_id", "child_pos", "leaf_pos", "start_char", "end_char", "x0", "y0", "x1", "y1", "token_count", "stable_hash"]


def classify(blocks: DataFrame) -> DataFrame:
    """Merged blocks with text t, whether each is a heading, and its place ``pos`` in reading order."""
    b = blocks.withColumn("t", T.normalize_text(F.col("text"))).where("t <> ''")
    b = b.withColumn("heading", T.is_heading(F.col("t"), F.col("font_size"), F.col("is_bold"), F.col("median"), True))
    return b.withColumn("pos", F.row_number().over(W.partitionBy(*SIDE).orderBy("page", "block_pos")))


def heading_paths(classified: DataFrame) -> DataFrame:
    """Adds ``path``: that of the last numbered heading so far, before any that of the first heading, else empty."""
    so_far = W.partitionBy(*SIDE).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbered = F.when(F.col("heading"), T.numbered_path(F.col("t"), True))
    named = F.when(F.col("heading"), F.array(T.slug(F.col("t"), True)))
    return classified.withColumn("path", F.coalesce(F.last(numbered, True).over(so_far), F.first(named, True).over(so_far), F.array().cast("array<string>")))


def chunks(pathed: DataFrame, cap: int = 220) -> DataFrame:
    """Body text grouped greedily: (side, page, pos of the first part, chunk, kind, path, text, box)."""
    parts = pathed.where("not heading").select("*", F.posexplode(T.split_paragraphs(F.col("t"), True)).alias("part", "ptext"))
    parts = parts.withColumn("tokens", T.token_count(F.col("ptext"))).withColumn("bullet", F.col("ptext").rlike(T.BULLET))
    page = W.partitionBy(*SIDE, "page").orderBy("pos", "part")
    before = F.lag("ptext").over(page)
    # a heading between two parts shows as a gap in pos beyond the blocks of body text
    broken = (
        before.isNull()
        | (F.col("pos") - F.lag("pos").over(page) > 1)
        | F.col("bullet")
        | T.heading_like(F.col("ptext"), True)
        | (before.rlike(r"[.!?;:]$") & F.col("ptext").rlike(r"^\p{Lu}"))
    )
    parts = parts.withColumn("run", F.sum(broken.cast("int")).over(page))
    run = parts.groupBy(*SIDE, "page", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "ptext", "tokens", "bullet", "path", "x0", "y0", "x1", "y1"))).alias("xs"))
    run = run.withColumn("ids", T.capped_groups(F.transform("xs", lambda x: x["tokens"]), cap))
    flat = run.select(*SIDE, "page", "run", F.explode(F.arrays_zip("xs", "ids")).alias("z")).select(*SIDE, "page", "run", "z.ids", "z.xs.*")
    return flat.groupBy(*SIDE, "page", "run", "ids").agg(
        F.min(F.struct("pos", "part")).alias("at"),
        F.min(F.struct("pos", "part", "bullet")).alias("f"),
        F.first("path").alias("path"),
        T.normalize_text(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part", "ptext"))), lambda x: x["ptext"]), "\n\n")).alias("text"),
        F.sum("tokens").alias("part_tokens"),
        F.count(F.lit(1)).alias("n_parts"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).select(*SIDE, "page", F.col("at.pos").alias("pos"), F.col("at.part").alias("part"), F.when(F.col("f.bullet"), "bullet").otherwise("paragraph").alias("kind"), "path", "text", "part_tokens", "n_parts", "x0", "y0", "x1", "y1")


def _pathed(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    kept = staged(drop_repeated_headers(blocks, pages), "kept-blocks")  # read twice
    return heading_paths(classify(merge_blocks(kept, median_font(kept)))).drop("text")  # t is the text that is used


def _heads(pathed: DataFrame) -> DataFrame:
    return pathed.where("heading").select(*SIDE, "page", "pos", F.lit(0).alias("part"), F.lit("section").alias("kind"), "path", "t", T.short_title(F.col("t"), True).alias("text"), "x0", "y0", "x1", "y1")


def _named(leaves: DataFrame) -> DataFrame:
    """Adds n, the number of a leaf among the sections or bodies of its page, and node_id."""
    section = F.col("kind") == "section"
    leaves = leaves.withColumn("n", F.row_number().over(W.partitionBy(*SIDE, "page", section).orderBy("pos", "part")))
    return leaves.withColumn("node_id", F.when(section, T.node_id(F.col("doc_side"), F.col("page"), F.col("path"), "section", F.col("n"))).otherwise(T.node_id(F.col("doc_side"), F.col("page"), F.col("path"), "para", F.col("n"))))


def sections(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The sections among the leaves of build_nodes(), without making the other nodes: (side, node_id, page, kind, path, text,
    leaf_pos, token_count). leaf_pos is their order, but counts blocks."""
    named = _named(_heads(_pathed(blocks, pages)))
    return named.select(*SIDE, "node_id", "page", "kind", "path", "text", F.col("pos").alias("leaf_pos"), T.token_count(F.col("t")).alias("token_count"))


def build_nodes(blocks: DataFrame, pages: DataFrame, cap: int = 220) -> DataFrame:
    """All nodes (NODE_COLUMNS) of the documents in ``blocks``; ``pages`` has pair_id, doc_side, page_count and may have
    source_path, the text of the document node.

    Documents without blocks have a document node and page nodes only. Blocks of white space are left out."""
    pathed = staged(_pathed(blocks, pages), "pathed-blocks")  # read twice, and each reading would run what is below it again
    heads = _heads(pathed)
    body = chunks(pathed, cap).withColumn("t", F.col("text")).select(*heads.columns)
    leaves = heads.unionByName(body)
    section = F.col("kind") == "section"
    leaves = _named(leaves)
    order = W.partitionBy(*SIDE).orderBy("page", "pos", "part")
    last_section = F.last(F.when(section, F.col("node_id")), True).over(order.rowsBetween(W.unboundedPreceding, 0))
    leaves = leaves.withColumn("parent_id", F.when(section, page_id()).otherwise(F.coalesce(last_section, root_id())))
    leaves = leaves.withColumn("leaf_pos", F.row_number().over(order) - 1)
    # children of the document node are its pages and, before the first heading, body nodes: each page, then its leaves
    family = W.partitionBy(*SIDE, "parent_id").orderBy("page", F.asc_nulls_first("leaf_pos"))
    none = F.lit(None).cast("int")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    leaves = leaves.select(*SIDE, "node_id", "page", "kind", "path", "text", "parent_id", none.alias("child_pos"), "leaf_pos", F.lit(0).alias("start_char"), F.length("t").alias("end_char"), *box, T.token_count(F.col("t")).alias("token_count"), T.stable_hash(F.col("t")).alias("stable_hash"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    bare = [F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), *empty, F.lit(0).alias("token_count"), F.lit("").alias("stable_hash")]
    no_path = F.array().cast("array<string>").alias("path")
    name = F.col("source_path") if "source_path" in pages.columns else F.concat_ws(":", "pair_id", "doc_side")
    roots = pages.select(*SIDE, root_id().alias("node_id"), F.lit(0).alias("page"), F.lit("document").alias("kind"), no_path, name.alias("text"), F.lit(None).cast("string").alias("parent_id"), none.alias("child_pos"), none.alias("leaf_pos"), *bare)
    each = pages.where("page_count > 0").select(*SIDE, F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    page_nodes = each.select(*SIDE, page_id().alias("node_id"), "page", F.lit("page").alias("kind"), no_path, F.format_string("Page %d", "page").alias("text"), root_id().alias("parent_id"), none.alias("child_pos"), none.alias("leaf_pos"), *bare)
    below = page_nodes.unionByName(leaves).withColumn("child_pos", F.row_number().over(family) - 1)
    return roots.unionByName(below).select(*NODE_COLUMNS)


def root_id():
    return F.concat("doc_side", F.lit(":document"))


def page_id():
    return F.format_string("%s:p%02d:page", "doc_side", "page")


def leaves(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Leaves, or those of the given kinds; leaf_pos is their order."""
    found = nodes.where("leaf_pos is not null")
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def node_lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def write_tree(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(path)


def read_tree(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
