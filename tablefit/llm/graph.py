"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import materialize

ROUNDS = 60  # far above the logarithm of any number of nodes


def spanning_edges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given edges: (member, smallest node)."""
    if not len(left):
        return left, right
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[:len(left)], index[len(left):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    for batch in batches:
        a, b = spanning_edges(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (long ids); root is the smallest node of its component.

    Each round writes its edges to the shared folder. Nothing is gathered by node: only minima are aggregated, and joins
    on nodes can be split, so a node with very many edges is no hot key. An edge table without rows gives no rows.
    """
    edges = edges.filter("a <> b").selectExpr("a", "b").mapInArrow(_contract, "a bigint, b bigint")
    edges = materialize(edges.distinct(), "edges")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a", "least(a, low) AS low")
        # Written, so that both sides of the join are plain shuffles, which AQE splits at nodes with very many edges.
        low = materialize(low, "low")
        # Large star: every larger neighbour moves to the smallest node around.
        large = both.filter("b > a").join(low, "a").selectExpr("b AS a", "low AS b").filter("a <> b").distinct()
        large = materialize(large, "large")
        # Small star: every smaller neighbour, and the node itself, moves to the smallest of them.
        down = large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(materialize(least, "least"), "a").selectExpr("explode(array(a, b)) AS a", "low AS b").filter("a <> b").distinct()
        small = materialize(small, "small")
        state = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("sum")).first()
        before = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("sum")).first()
        edges = small
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).selectExpr("a AS node", "root").unionByName(
        edges.select(F.col("b").alias("node")).distinct().selectExpr("node", "node AS root"))
