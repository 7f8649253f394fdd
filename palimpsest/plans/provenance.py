"""Where a node comes from: parents, children, ancestors, neighbours, and the context pack of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.layout import SIDE
from palimpsest.operators.vectors import neighbours, sections_of

#: A document, its pages, their sections and their bodies: no node is deeper.
DEPTH = 4
NODE = ["node_id", "doc_side", "page", "kind", "path", "text", "parent_id", "start_char", "end_char", "token_count", "stable_hash"]


def parent_map(nodes: DataFrame) -> DataFrame:
    return nodes.select(*SIDE, "node_id", "parent_id")


def children_map(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, children of nodes that have any, in order."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("child_pos", "node_id"))), lambda x: x["node_id"])
    return nodes.where("parent_id is not null").groupBy(*SIDE, F.col("parent_id").alias("node_id")).agg(kids.alias("children"))


def ancestor_chain(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, ancestors (nearest first)."""
    out = nodes.select(*SIDE, "node_id", F.col("parent_id").alias("p"), F.array().cast("array<string>").alias("ancestors"))
    up = nodes.select(*SIDE, F.col("node_id").alias("p"), F.col("parent_id").alias("pp"))
    for _ in range(DEPTH - 1):
        out = out.join(up, [*SIDE, "p"], "left").select(*SIDE, "node_id", F.col("pp").alias("p"), F.when(F.col("p").isNull(), F.col("ancestors")).otherwise(F.array_append("ancestors", F.col("p"))).alias("ancestors"))
    return out.select(*SIDE, "node_id", "ancestors")


def ancestor_section(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, section_id: the nearest section above each leaf that has one."""
    kinds = nodes.where("kind = 'section'").select(*SIDE, F.col("node_id").alias("a"))
    up = ancestor_chain(nodes.where("leaf_pos is not null or kind in ('page', 'document')")).select(*SIDE, "node_id", F.posexplode("ancestors").alias("i", "a"))
    return up.join(kinds, [*SIDE, "a"]).groupBy(*SIDE, "node_id").agg(F.min(F.struct("i", "a"))["a"].alias("section_id"))


def section_children(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """pair_id, doc_side, node_id, children (first ``limit`` ids) of sections."""
    s = nodes.where("kind = 'section'").select(*SIDE, "node_id")
    return s.join(children_map(nodes), [*SIDE, "node_id"], "left").select(*SIDE, "node_id", F.slice(F.coalesce("children", F.array().cast("array<string>")), 1, limit).alias("children"))


def section_context(nodes: DataFrame, window: int = 1) -> DataFrame:
    """pair_id, doc_side, node_id, ancestors, children (12 at most), neighbours of sections."""
    near = neighbours(nodes, window).select(*SIDE, "node_id", F.col("ids").alias("neighbours"))
    return section_children(nodes, 12).join(ancestor_chain(nodes), [*SIDE, "node_id"]).join(near, [*SIDE, "node_id"])


def trace_nodes(nodes: DataFrame) -> DataFrame:
    """Every node as a struct with its ancestors and children."""
    n = nodes.select(*SIDE, "node_id", F.struct(*NODE).alias("node"))
    return n.join(ancestor_chain(nodes), [*SIDE, "node_id"]).join(children_map(nodes), [*SIDE, "node_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def expand_section(nodes: DataFrame, window: int = 2) -> DataFrame:
    """pair_id, doc_side, node_id, ids: a section with its first 20 children and its neighbours, or a body after its
    section and that section's first 10 children, then its neighbours; ids may repeat."""
    leaves = nodes.where("leaf_pos is not null").select(*SIDE, "node_id", "kind")
    near = neighbours(nodes, window).select(*SIDE, "node_id", "ids")
    kids = section_children(nodes, 20).select(*SIDE, F.col("node_id").alias("section_id"), "children")
    x = leaves.join(sections_of(nodes), [*SIDE, "node_id"]).join(kids, [*SIDE, "section_id"], "left").join(near, [*SIDE, "node_id"])
    own = F.array("node_id")
    body = F.when(F.col("section_id").isNull(), own).otherwise(F.concat(F.array("section_id"), F.slice("children", 1, 10), own))
    ids = F.when(F.col("kind") == "section", F.concat(own, "children", "ids")).otherwise(F.concat(body, "ids"))
    return x.select(*SIDE, "node_id", ids.alias("ids"))


def context_packs(changes: DataFrame, nodes: DataFrame, window: int = 1) -> DataFrame:
    """One row per change that isn't 'unchanged': nodes, sections with their contexts, neighbours, evidence."""
    out = changes.where("change_type <> 'unchanged'")
    near = neighbours(nodes, window).select(*SIDE, "node_id", "ids", "texts")
    ctx = section_context(nodes, window)
    ctx = ctx.select(*SIDE, F.col("node_id").alias("section_id"), F.struct("ancestors", "children", "neighbours").alias("section"))
    known = nodes.where("leaf_pos is not null").select(*SIDE, "node_id", F.struct(*NODE).alias("node"))
    known = known.join(sections_of(nodes), [*SIDE, "node_id"], "left").join(near, [*SIDE, "node_id"], "left").join(ctx, [*SIDE, "section_id"], "left")
    for side in ("legacy", "modern"):
        n = known.where(F.col("doc_side") == side).select("pair_id", F.col("node_id").alias(f"{side}_id"), F.col("node").alias(f"{side}_node"), F.col("section_id").alias(f"{side}_section_id"), F.col("section").alias(f"{side}_section"), F.col("ids").alias(f"{side}_neighbours"), F.col("texts").alias(f"{side}_neighbour_texts"))
        out = out.join(n, ["pair_id", f"{side}_id"], "left")
    stats = F.struct(F.col("similarity").alias("cosine"), F.col("lexical_score").alias("lexical"), "heading_bonus", "page_bonus")
    none = F.lit("none")
    return out.select("pair_id", "match_seq", F.concat_ws("::", F.coalesce("legacy_id", none), F.coalesce("modern_id", none)).alias("match_id"), "change_type", stats.alias("stats"), *[f"{s}_{c}" for s in ("legacy", "modern") for c in ("node", "section_id", "section", "neighbours", "neighbour_texts")], "evidence_ids")
