"""Vectors of node texts: hashed words as sparse rows, cosine by a join on the bucket, context texts for embedding."""

from __future__ import annotations

import hashlib
import importlib
import math
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators.layout import SIDE

#: Fixed limits of the context texts.
CHILDREN, CHILD_CHARS, SECTION_CHARS, BODY_CHARS, NEIGHBOUR_CHARS, PLAIN_CHARS = 4, 1200, 2200, 1800, 320, 1200


def hash_vectors(texts: DataFrame, keys: list[str], text_col: str = "text", dim: int = 768) -> DataFrame:
    """keys, bucket, w: counts of hashed lower-case words of two characters or more, L2-normalised per text."""
    found = texts.select(*keys, F.inline(V.unpacked(V.hashed(F.col(text_col), dim))))
    return found.select(*keys, "bucket", "w")


def hashed_list(text: str, dim: int) -> list[float]:
    """hash_vectors() of one text, not normalised, as a list."""
    out = [0.0] * dim
    for token in regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower()):
        out[int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % dim] += 1.0
    return out


def model_vectors(texts: DataFrame, keys: list[str], embedder: str | Callable, text_col: str = "text", dim: int = 768, batch_size: int = 64) -> DataFrame:
    """keys, vec: L2-normalised vectors of ``dim`` numbers from ``embedder``, a function of a list of texts or its name as
    'module:function', at most ``batch_size`` texts at a time. Texts of a batch for which it can't be loaded, raises, or
    gives vectors of another shape get hashed ones."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        known, out = s.fillna("").tolist(), []
        for at in range(0, len(known), batch_size):
            part = known[at : at + batch_size]
            try:
                call = embedder
                if isinstance(embedder, str):
                    module, _, name = embedder.partition(":")
                    call = getattr(importlib.import_module(module), name)
                found = [[float(x) for x in v] for v in call(part)]
                if [len(v) for v in found] != [dim] * len(part):
                    raise ValueError("vectors of another shape")
            except Exception:
                found = [hashed_list(t, dim) for t in part]
            out += [[x / max(math.sqrt(math.fsum(y * y for y in v)), 1e-12) for x in v] for v in found]
        return pd.Series(out, dtype=object)

    return texts.select(*keys, run(F.col(text_col)).alias("vec"))


def dense(vectors: DataFrame, keys: list[str], dim: int = 768) -> DataFrame:
    """Sparse rows to arrays of ``dim`` numbers."""
    pairs = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return pairs.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def packed(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec: rows of keys, bucket, w as one packed vector each."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), F.col("w").cast("double").alias("w"))))
    return vectors.groupBy(*keys).agg(V.packed(entries).alias("vec"))


def neighbours(nodes: DataFrame, window: int = 1) -> DataFrame:
    """pair_id, doc_side, node_id, ids and texts of the leaves up to ``window`` before and after, in order."""
    w = W.partitionBy(*SIDE).orderBy("leaf_pos")
    near = F.collect_list(F.struct("leaf_pos", "node_id", "text")).over(w.rowsBetween(-window, window))
    n = nodes.where("leaf_pos is not null").select(*SIDE, "node_id", "leaf_pos", near.alias("near"))
    others = F.filter("near", lambda x: x["leaf_pos"] != F.col("leaf_pos"))
    return n.select(*SIDE, "node_id", F.transform(others, lambda x: x["node_id"]).alias("ids"), F.filter(F.transform(others, lambda x: T.strip(x["text"])), lambda x: x != "").alias("texts"))


def sections_of(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, section_id of leaves: a section itself, or the parent if that is a section."""
    parents = nodes.where("kind = 'section'").select(*SIDE, F.col("node_id").alias("parent_id"), F.lit(True).alias("found"))
    n = nodes.where("leaf_pos is not null").join(parents, [*SIDE, "parent_id"], "left")
    return n.select(*SIDE, "node_id", F.when(F.col("kind") == "section", F.col("node_id")).when(F.col("found"), F.col("parent_id")).alias("section_id"))


def _section_previews(nodes: DataFrame) -> DataFrame:
    w = W.partitionBy(*SIDE, "parent_id").orderBy("child_pos")
    c = nodes.where("kind in ('paragraph', 'bullet')").withColumn("s", T.strip(F.col("text"))).where("s <> ''")
    c = c.withColumn("rn", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum(F.length("s")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.where((F.col("rn") <= CHILDREN) & (F.col("before") < CHILD_CHARS))
    return c.groupBy(*SIDE, F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), " ").alias("preview"))


def _named(label: str, value: Column) -> Column:
    """'label: value', or null where there is none, which concat_ws leaves out."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def section_contexts(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, context_text of sections: path, title and a preview of the first children."""
    s = nodes.where("kind = 'section'").join(_section_previews(nodes), [*SIDE, "node_id"], "left")
    parts = [_named("Heading path", T.path_text(F.col("path"))), _named("Section title", T.strip(F.col("text"))), _named("Preview", F.col("preview"))]
    return s.select(*SIDE, "node_id", T.truncate_text(F.concat_ws("\n\n", *parts), SECTION_CHARS).alias("context_text"))


def body_contexts(nodes: DataFrame, window: int = 1) -> DataFrame:
    """pair_id, doc_side, node_id, context_text of paragraphs and bullets: section, path, text, neighbours."""
    sec = nodes.where("kind = 'section'").select(*SIDE, F.col("node_id").alias("section_id"), F.col("path").alias("spath"), F.col("text").alias("stext"))
    b = nodes.where("kind in ('paragraph', 'bullet')").join(sections_of(nodes), [*SIDE, "node_id"]).join(sec, [*SIDE, "section_id"], "left").join(neighbours(nodes, window), [*SIDE, "node_id"])
    near = F.array_join(F.transform(F.slice("texts", 1, 2), lambda x: T.truncate_text(x, NEIGHBOUR_CHARS)), " ")
    parts = [_named("Section path", T.path_text(F.col("spath"))), _named("Section heading", T.strip(F.col("stext"))), _named("Node path", T.path_text(F.col("path"))), F.concat(F.initcap("kind"), F.lit(": "), T.strip(F.col("text"))), _named("Neighbor context", near)]
    return b.select(*SIDE, "node_id", T.truncate_text(F.concat_ws("\n\n", *parts), BODY_CHARS).alias("context_text"))


def plain_contexts(nodes: DataFrame) -> DataFrame:
    """pair_id, doc_side, node_id, context_text of nodes of any kind: path and text."""
    text = F.when(F.col("text") != "", T.strip(F.col("text")))
    parts = [F.when(F.size("path") > 0, F.concat(F.lit("Path: "), T.path_text(F.col("path")))), text]
    return nodes.select(*SIDE, "node_id", T.truncate_text(F.concat_ws("\n\n", *parts), PLAIN_CHARS).alias("context_text"))


def embed_plan(nodes: DataFrame, sections: bool = True, bodies: bool = True, window: int = 1) -> DataFrame:
    """pair_id, doc_side, node_id, level, ord, section_id, context_text: what to embed, in leaf order per level."""
    parts = []
    if sections:
        parts.append(section_contexts(nodes).withColumn("level", F.lit("section")))
    if bodies:
        parts.append(body_contexts(nodes, window).withColumn("level", F.lit("body")))
    if not parts:
        return section_contexts(nodes.where("false")).withColumn("level", F.lit("section")).withColumn("ord", F.lit(0)).withColumn("section_id", F.lit(""))
    plan = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    plan = plan.join(nodes.select(*SIDE, "node_id", "leaf_pos"), [*SIDE, "node_id"]).join(sections_of(nodes), [*SIDE, "node_id"], "left")
    ord_ = F.row_number().over(W.partitionBy(*SIDE, "level").orderBy("leaf_pos")) - 1
    return plan.select(*SIDE, "node_id", "level", ord_.alias("ord"), "section_id", "context_text")
