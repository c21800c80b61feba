"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): every node's neighbours (large: the larger ones) are tied to the least of its neighbourhood."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


#: Edges up to which one task contracts what is left (16 bytes each).
FEW_EDGES = 1 << 20


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that are few: by pointer jumping over all of them in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        while (root[root] != root).any():
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root): the least node of its component for every node that an edge (u, v) names. No edges, no rows.

    Edges that are few (counted) are contracted in one task. More of them take star steps until they settle or the
    edges between what is not settled yet are few.
    """
    now = stored(edges.select("u", "v").where("u != v").distinct(), "edges")
    if now.count() <= few:
        return _contracted(now)
    before = None
    while True:
        now = stored(_stars(_stars(now, True), False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    # Settled: every edge ties a node to its root.
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
