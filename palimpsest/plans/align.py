"""Alignment of the legacy and modern sides of document pairs in four stages.

Sections are matched first, then the bodies within matched sections, then the remaining bodies with one another; what is
left over is removed or added. Pairs are only formed where they may match: an equi-join on pair and kind class (and on the
matched sections), and the assignment runs per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import documents as D
from palimpsest.functions import scores as S
from palimpsest.functions.lexical import lexical, lexical_ratio  # noqa: F401  (used through this module)
from palimpsest.functions.vectors import terms
from palimpsest.operators.assignment import assign
from palimpsest.operators.layout import LEAST, SHARE, SIDE
from palimpsest.operators.vectors import hash_vectors, model_vectors, packed, sections_of
from palimpsest.params import Params
from palimpsest.plans.staging import staged

#: Tasks that form the pairs of a large group of leaves: pages have few groups, one per language, with many sections.
SPREAD = 64
#: Leaves of a document that are scored at a time against as many of another one.
BLOCK = 256

FIELDS = ["node_id", "kind", "path", "page", "token_count", "text", "leaf_pos"]


def sides(nodes: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Leaves of the two sides, with columns legacy_* and modern_*, their kind class, pair_id and ``keys``; packed vectors
    come along where ``nodes`` has them."""
    out = []
    for side in ("legacy", "modern"):
        n = nodes.where((F.col("doc_side") == side) & F.col("leaf_pos").isNotNull())
        names = {"node_id": f"{side}_id", "leaf_pos": f"{side}_pos"}
        fields = [*FIELDS, "vec"] if "vec" in n.columns else FIELDS
        out.append(n.select("pair_id", S.kind_class(F.col("kind")).alias("kind_class"), *keys, *[F.col(c).alias(names.get(c, f"{side}_{c}")) for c in fields]))
    return out[0], out[1]


def candidate_pairs(left: DataFrame, right: DataFrame, on: list[str], spread: int = 1) -> DataFrame:
    """Pairs of equal kind class within equal ``on``, with every feature but the lexical one. With ``spread``, a group's pairs
    are formed in that many tasks, by parts of its left side; each gets a copy of the right side."""
    keys = [*on, "kind_class"]
    if spread == 1:  # groups are dealt by number: tasks merged by their input would be few, and each long
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    else:
        left = left.withColumn("part", F.pmod(F.xxhash64("legacy_id"), F.lit(spread)).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        keys = [*keys, "part"]  # by number, as tasks are merged by their input otherwise, and the pairs are what counts
        left, right = left.repartition(2 * spread, *keys), right.repartition(2 * spread, *keys)
    return features(left.join(right, keys).drop("part"))


def features(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "*",
        S.heading_similarity(F.col("legacy_path"), F.col("modern_path")).alias("heading"),
        S.kind_compatibility(F.col("legacy_kind"), F.col("modern_kind")).alias("kind_bonus"),
        S.token_balance(F.col("legacy_token_count"), F.col("modern_token_count")).alias("size_bonus"),
        S.page_bonus(F.col("legacy_page"), F.col("modern_page")).alias("page_bonus"),
    )


def _hybrid(cos: Column, lex: Column) -> Column:
    return S.hybrid_score(cos, lex, F.col("heading"), F.col("page_bonus"), F.col("legacy_kind"), F.col("modern_kind"), F.col("size_bonus"))


def score_pairs(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """Adds cos, lex, raw and candidate to pairs with their texts and packed vectors. With ``least``, pairs whose raw score
    stays below it are left out, and lex is null where the candidate is 1 whatever it is.

    Each pair is scored where it was formed, so none is dealt anew and texts and vectors go no further."""
    rest = _hybrid(F.lit(0.0), F.lit(0.0))
    weight = _hybrid(F.lit(1.0), F.lit(0.0)) - rest
    p = pairs.withColumn("terms", terms(F.col("legacy_vec"), F.col("modern_vec"), F.col("legacy_text"), F.col("modern_text"), rest, weight, least))
    if least is not None:
        p = p.where("terms is not null")
    p = p.withColumn("cos", F.col("terms")[0]).withColumn("lex", F.col("terms")[1])
    p = p.drop("terms", *[f"{s}_{c}" for s in ("legacy", "modern") for c in ("text", "path", "vec")]).withColumn("base", _hybrid(F.col("cos"), F.lit(0.0)))
    if least is not None:
        p = p.where(F.col("base") + 0.1 * F.col("lex") + 1e-9 >= least).withColumn("lex", F.when(F.col("base") < 1, F.col("lex")))
    raw = F.col("base") + 0.1 * F.coalesce("lex", F.lit(0.0))
    return p.withColumn("raw", raw).withColumn("candidate", S.clip01(F.col("raw"))).drop("base")


def _blocks(leaves: DataFrame, keys: list[str], order: list[str], *columns: Column) -> DataFrame:
    """keys, block, leaves, n: leaves as structs of ``columns``, BLOCK of them a row; n is how many blocks their group has."""
    w = W.partitionBy(*keys)
    x = leaves.select(*keys, F.struct(*columns).alias("leaf"), F.floor((F.row_number().over(w.orderBy(*order)) - 1) / BLOCK).alias("block"), F.ceil(F.count(F.lit(1)).over(w) / BLOCK).alias("n"))
    return x.groupBy(*keys, "block").agg(F.collect_list("leaf").alias("leaves"), F.first("n").alias("n"))


def meetings(legacy: DataFrame, modern: DataFrame, keys: list[str]) -> DataFrame:
    """keys, legacy, modern: every block of the one side with every block of the other of equal ``keys``. A large group
    spreads over SPREAD tasks by its legacy blocks, each of which gets the modern ones."""
    tasks = max(2 * SPREAD, int(legacy.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number, as in candidate_pairs()
    parts = legacy.where("block = 0").select(*keys, F.least(F.col("n"), F.lit(SPREAD)).cast("int").alias("parts"))
    left = legacy.select(*keys, F.pmod("block", F.least(F.col("n"), F.lit(SPREAD))).cast("int").alias("part"), F.col("leaves").alias("legacy"))
    right = modern.join(parts, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leaves").alias("modern"))
    return left.repartition(tasks, *keys, "part").join(right.repartition(tasks, *keys, "part"), [*keys, "part"]).drop("part")


def block_edges(left: DataFrame, right: DataFrame, on: list[str], params: Params, name: str = "pos") -> DataFrame:
    """on, kind_class, legacy_<name>, modern_<name>, lex, candidate, cos of the pairs of sides() that reach the least similarity
    within equal ``on``, in the scores of score_pairs(); leaves are scored where two blocks of them meet."""
    keys, made = [*on, "kind_class"], []
    for side, leaves in (("legacy", left), ("modern", right)):
        fields = [F.col(f"{side}_{name}").cast("string").alias("id"), *[F.col(f"{side}_{c}") for c in ("kind", "path", "page", "token_count", "text", "vec") if f"{side}_{c}" in leaves.columns]]
        made.append(_blocks(leaves, keys, [f"{side}_pos"], *fields))
    met = meetings(*made, keys).select(*keys, D.edges(F.col("legacy"), F.col("modern"), params.vector_dim, params.min_similarity).alias("edges"))
    met = met.select(*keys, F.inline("edges"))
    kind = "string" if name == "id" else "int"
    return met.select(*keys, *[F.col(f"{side}_id").cast(kind).alias(f"{side}_{name}") for side in ("legacy", "modern")], "lex", "candidate", "cos")


def block_ratios(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on, legacy_id, modern_id, lex (six digits) of every pair of sides() within equal ``on``. Leaves stand by their texts, so
    that equal ones share a block and are compared once."""
    keys, made = [*on, "kind_class"], []
    for side, leaves in (("legacy", left), ("modern", right)):
        made.append(_blocks(leaves, keys, [f"{side}_text", f"{side}_id"], F.col(f"{side}_id").alias("id"), F.col(f"{side}_text").alias("text")))
    met = meetings(*made, keys).select(*on, F.col("legacy.id").alias("l"), F.col("modern.id").alias("m"), D.ratios(F.col("legacy.text"), F.col("modern.text")).alias("r"))
    rows = met.select(*on, "m", F.inline(F.arrays_zip("l", "r"))).withColumnRenamed("l", "legacy_id")
    return rows.select(*on, "legacy_id", F.inline(F.arrays_zip(F.col("m").alias("modern_id"), F.col("r").alias("lex"))))


def document_edges(linked: DataFrame, params: Params, lines_per_page: int) -> DataFrame:
    """pair_id, legacy_id, modern_id, lex, candidate of the leaf pairs of stored documents that reach the least similarity:
    what score_pairs() gives over the nodes of their blocks. ``linked`` is as of ``adapters.linked_texts``.

    A document's leaves are made once, from its text, and those of two documents are scored where these meet, in parts of
    BLOCK leaves a side, so a row is bounded whatever the number of pairs."""
    made = linked.withColumn("leaves", D.leaves(F.col("text"), lines_per_page, SHARE, LEAST, params.max_tokens_per_node)).drop("text").where(F.size("leaves") > 0)
    parts = made.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("leaves"), F.lit(BLOCK)))).withColumn("leaves", F.slice("leaves", F.col("at"), BLOCK)).drop("at")
    parts = staged(parts, "leaves")
    n = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as in candidate_pairs()
    legacy = parts.where("followed").select(F.col("name").alias("pair_id"), F.col("leaves").alias("legacy")).repartition(n, "pair_id")
    modern = parts.where("before is not null").select(F.col("before").alias("pair_id"), F.col("leaves").alias("modern")).repartition(n, "pair_id")
    found = legacy.join(modern, "pair_id").select("pair_id", D.edges(F.col("legacy"), F.col("modern"), params.vector_dim, params.min_similarity).alias("edges"))
    found = found.select("pair_id", F.inline("edges"))
    return found.select("pair_id", *[F.concat(F.lit(side), f"{side}_id").alias(f"{side}_id") for side in ("legacy", "modern")], "lex", "candidate")


def match(left: DataFrame, right: DataFrame, on: list[str], params: Params, stage: str) -> DataFrame:
    """Matched pairs of one stage with lexical, similarity and change type."""
    # no edge joins two kind classes, so each is a problem of its own
    keys = [*on, "kind_class"]
    edges = block_edges(left, right, on, params)
    slim = assign(edges.select(*keys, "candidate", "cos", "legacy_pos", "modern_pos"), keys, params.min_similarity).drop("kind_class")
    # the texts come back by the places of the matched leaves alone
    left, right = left.drop("legacy_vec"), right.drop("modern_vec", "kind_class")
    found = features(slim.join(left, [*on, "legacy_pos"]).join(right, [*on, "modern_pos"]))
    found = found.withColumn("lexical_score", lexical(F.col("legacy_text"), F.col("modern_text")))
    again = _hybrid(F.col("candidate"), F.col("lexical_score")) if params.score_mode == "double" else F.col("candidate")
    found = found.withColumn("similarity", again).withColumn("heading_bonus", 0.08 * F.col("heading"))
    found = found.withColumn("change_type", S.change_type(F.col("similarity"), params.unchanged_threshold))
    return found.select("pair_id", F.lit(stage).alias("stage"), "legacy_id", "modern_id", "cos", "candidate", "similarity", "lexical_score", "change_type", "heading_bonus", "page_bonus")


def leaf_vectors(leaves: DataFrame, params: Params) -> DataFrame:
    """pair_id, doc_side, node_id, bucket, w: hashed, or by the model that ``params.embedder`` is or names."""
    keys = [*SIDE, "node_id"]
    if params.embedder == "hash":
        return hash_vectors(leaves, keys, "text", params.vector_dim)
    dense = model_vectors(leaves, keys, params.embedder, "text", params.vector_dim, params.batch_size)
    return dense.select(*keys, F.posexplode("vec").alias("bucket", "w")).where("w <> 0")


def leaves_of(nodes: DataFrame) -> DataFrame:
    """Leaves of trees with the section that each belongs to, if any."""
    return nodes.where("leaf_pos is not null").join(sections_of(nodes), [*SIDE, "node_id"], "left").select(*SIDE, *FIELDS, "section_id")


def document_leaves(linked: DataFrame, params: Params, lines_per_page: int) -> DataFrame:
    """leaves_of() of the trees of stored documents, made from their texts; ``linked`` is as of ``adapters.linked_texts``."""
    made = linked.withColumn("leaves", D.leaves(F.col("text"), lines_per_page, SHARE, LEAST, params.max_tokens_per_node)).drop("text").where(F.size("leaves") > 0)
    made = staged(made, "leaves")
    sides = made.where("followed").select(F.col("name").alias("pair_id"), F.lit("legacy").alias("doc_side"), "leaves").unionByName(made.where("before is not null").select(F.col("before").alias("pair_id"), F.lit("modern").alias("doc_side"), "leaves"))
    rows = sides.select(*SIDE, F.posexplode("leaves").alias("leaf_pos", "leaf"))
    rows = rows.select(*SIDE, F.concat("doc_side", "leaf.id").alias("node_id"), "leaf.kind", "leaf.path", "leaf.page", F.col("leaf.tokens").alias("token_count"), "leaf.text", "leaf_pos")
    so_far = W.partitionBy(*SIDE).orderBy("leaf_pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*SIDE, *FIELDS, F.last(F.when(F.col("kind") == "section", F.col("node_id")), True).over(so_far).alias("section_id"))


def align_stages(nodes: DataFrame, params: Params = Params(), last: str = "unmatched", vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """matched pairs of the stages 'sections', 'children' and 'fallback', and 'unmatched' leaves of either side; stages
    after ``last`` aren't run. ``nodes`` may be leaves with their sections instead, as of leaves_of(). ``vectors`` are those
    of leaf_vectors(), where they are there already."""
    leaves = nodes if "section_id" in nodes.columns else leaves_of(nodes)
    if vectors is None and params.embedder == "hash":  # made where leaves are scored
        leaves = staged(leaves, "align-leaves")
    else:
        vectors = leaf_vectors(leaves, params) if vectors is None else vectors
        leaves = staged(leaves.join(packed(vectors, [*SIDE, "node_id"]), [*SIDE, "node_id"], "left"), "align-leaves")
    heads, body = leaves.where("kind = 'section'"), leaves.where("kind <> 'section'")
    sections = staged(match(*sides(heads), ["pair_id"], params, "sections"), "align-sections")

    if last == "sections":
        return {"sections": sections}
    matched = sections.select("pair_id", F.col("legacy_id").alias("ls"), F.col("modern_id").alias("ms"))
    left, right = sides(body, "section_id")
    left = left.join(matched, (left["pair_id"] == matched["pair_id"]) & (left["section_id"] == matched["ls"])).drop(matched["pair_id"]).drop("section_id")
    right = right.join(matched, (right["pair_id"] == matched["pair_id"]) & (right["section_id"] == matched["ms"])).drop(matched["pair_id"]).drop("section_id")
    children = staged(match(left, right, ["pair_id", "ls", "ms"], params, "children"), "align-children")

    if last == "children":
        return {"sections": sections, "children": children}
    taken = sections.select("pair_id", F.lit("legacy").alias("doc_side"), F.col("legacy_id").alias("section_id")).unionByName(sections.select("pair_id", F.lit("modern").alias("doc_side"), F.col("modern_id").alias("section_id")))
    free = body.join(taken, ["pair_id", "doc_side", "section_id"], "left_anti")
    fallback = staged(match(*sides(free), ["pair_id"], params, "fallback"), "align-fallback")

    pairs = sections.unionByName(children).unionByName(fallback)
    used = pairs.select("pair_id", F.lit("legacy").alias("doc_side"), F.col("legacy_id").alias("node_id")).unionByName(pairs.select("pair_id", F.lit("modern").alias("doc_side"), F.col("modern_id").alias("node_id")))
    rest = leaves.join(used, ["pair_id", "doc_side", "node_id"], "left_anti").join(taken.withColumn("in_matched", F.lit(True)), ["pair_id", "doc_side", "section_id"], "left")
    stage = F.when(F.col("kind") == "section", "leftover_sections").when(F.col("in_matched"), "children").otherwise("leftover_bodies")
    change = F.when(F.col("doc_side") == "legacy", "removed").otherwise("added")
    unmatched = rest.select(*SIDE, "node_id", "section_id", stage.alias("stage"), change.alias("change_type"))
    return {"sections": sections, "children": children, "fallback": fallback, "unmatched": unmatched, "leaves": leaves}


STAGE_ORDER = ("sections", "children", "fallback", "leftover_sections", "leftover_bodies")


def align(nodes: DataFrame, params: Params = Params(), vectors: DataFrame | None = None) -> DataFrame:
    """The change set: one record per matched pair and per leaf without a partner, numbered by match_seq per pair."""
    s = align_stages(nodes, params, vectors=vectors)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    pairs = s["sections"].unionByName(s["children"]).unionByName(s["fallback"]).drop("cos", "candidate").withColumn("evidence_ids", F.array("legacy_id", "modern_id"))
    u, zero = s["unmatched"], F.lit(0.0)
    old = F.col("doc_side") == "legacy"
    evidence = F.array_distinct(F.filter(F.array("section_id", "node_id"), lambda x: x.isNotNull()))
    alone = u.select("pair_id", "stage", F.when(old, F.col("node_id")).alias("legacy_id"), F.when(~old, F.col("node_id")).alias("modern_id"), zero.alias("similarity"), zero.alias("lexical_score"), "change_type", zero.alias("heading_bonus"), zero.alias("page_bonus"), evidence.alias("evidence_ids"))
    out = pairs.unionByName(alone)
    for side in ("legacy", "modern"):
        n = nodes.where((F.col("doc_side") == side) & F.col("leaf_pos").isNotNull()).select(
            "pair_id", F.col("node_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("path", "page", "text", "leaf_pos")], F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")).alias(f"{side}_span")
        )
        out = out.join(n, ["pair_id", f"{side}_id"], "left")
    return sort_changes(out)


def sort_changes(changes: DataFrame) -> DataFrame:
    stage = F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col("stage"))
    order = [F.asc_nulls_last("legacy_page"), F.asc_nulls_last("modern_page"), S.change_rank(F.col("change_type")), F.desc("similarity"), stage, F.asc_nulls_last("legacy_leaf_pos"), F.asc_nulls_last("modern_leaf_pos")]
    return changes.withColumn("match_seq", F.row_number().over(W.partitionBy("pair_id").orderBy(*order)))


def count_changes(changes: DataFrame) -> DataFrame:
    """Counts per pair; split and merged count as modified, other types don't count."""
    kinds = {"unchanged": ("unchanged",), "modified": ("modified", "split", "merged"), "added": ("added",), "removed": ("removed",)}
    return changes.groupBy("pair_id").agg(F.count(F.lit(1)).alias("match_count"), *[F.count(F.when(F.col("change_type").isin(*v), 1)).alias(f"{k}_count") for k, v in kinds.items()])
