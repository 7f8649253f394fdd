"""Connected components of a graph of links, by alternating large-star and small-star steps.

A step deals links by node, sorts them and streams over each node's neighbours, so a node with very many of them takes
no more memory than others. Links of a hub, a node that has a notable share of them, are dealt in parts: its smallest
neighbour is found by a partial aggregate and sent along. Links are never collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import HOT_SHARE, scratch, staged

EDGE = "a long, b long"
#: Fewest links of a hub; parts that its links are dealt in.
HUB, PARTS = 128, 64


def _dealt(links: DataFrame, n_links: int) -> DataFrame:
    """(a, part, b, low) sorted for a step; ``low`` is a hub's smallest neighbour, null elsewhere."""
    hubs = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("low"))
    hubs = hubs.where(F.col("n") > max(HUB, n_links // HOT_SHARE)).select("a", "low")  # HOT_SHARE hubs at most
    rows = links.join(F.broadcast(hubs), "a", "left").withColumn("part", F.when(F.col("low").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")))
    return rows.select("a", "part", "b", "low").repartition("a", "part").sortWithinPartitions("a", "part", "b")


def _with_first(batches):
    """(u, v, first v of u) of rows sorted by u, part and v."""
    last, first_v = None, 0
    for batch in batches:
        u, part, v = (batch.column(i).to_numpy() for i in range(3))
        if not len(u):
            continue
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (part[1:] != part[:-1])
        fresh[0] = last != (u[0], part[0])
        low = np.concatenate([[first_v], v[np.flatnonzero(fresh)]])[np.cumsum(fresh)]
        last, first_v = (u[-1], part[-1]), low[-1]
        told = batch.column(3)
        yield u, v, low if told.null_count == len(u) else np.where(np.asarray(told.is_null()), low, told.fill_null(0).to_numpy())


def _edges(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    keep = a != b
    pairs = np.unique(np.stack([a[keep], b[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["a", "b"])


def _large(batches):
    for u, v, low in _with_first(batches):
        far = v > u
        yield _edges(v[far], np.minimum(u, low)[far])


def _small(batches):
    for u, v, low in _with_first(batches):
        yield _edges(np.concatenate([u, v]), np.concatenate([low, low]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node each is linked with) of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:  # hook roots onto smaller ones, then shorten paths
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contract(batches):
    """Links of each batch as a forest of stars."""
    for b in batches:
        if b.num_rows:
            yield _edges(*forest(b.column(0).to_numpy(), b.column(1).to_numpy()))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a long, b long); the component is its smallest node.

    Null ends are left out; loops and repeated links are allowed; without links the result is empty.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    spark = edges.sparkSession
    edges = staged(edges.mapInArrow(_contract, EDGE), "links")
    mark = edges.count(), None
    while True:
        with scratch(spark):
            both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both")
            large = _dealt(both, 2 * mark[0]).mapInArrow(_large, EDGE)
            down = staged(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links-down")
            edges = staged(_dealt(down, mark[0]).mapInArrow(_small, EDGE).distinct(), "links", keep=True)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
