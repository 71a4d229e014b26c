"""Connected components of a link table by alternating large and small stars.

Each round moves every node's larger neighbours, then its smaller ones, to the smallest it sees;
the number of rounds grows with the logarithm of the longest chain. Minima are summed up before
they are shuffled, and joined back by node, so a node with very many links is split by Spark.
What lies in one Arrow batch is contracted before it is shuffled, and the rounds end as soon as every node points at
a root, which one count by node tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links that is not the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b that join the same nodes, at most one a node in each batch."""

    def work(batches):
        for batch in batches:
            a, b = forest(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(work, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link at most and roots have none, so that the links are the answer."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR (up > 0 AND down > 0)").agg(F.count("*")).first()[0] == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) with a > b."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # neighbours above the node go to the node's minimum
        moved = edges.select(F.col("b").alias("n"), F.col("a").alias("x")).join(low, "n").select(F.col("x").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = edges.select(F.col("a").alias("n"), F.col("b").alias("x")).join(low, "n").select(F.col("x").alias("a"), F.col("m").alias("b"))
        moved = moved.unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b")


def components(links: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable."""
    edges = written(_contracted(links), f"{tag}-edges")
    for _ in range(max_rounds):
        if _settled(edges):
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        edges = written(_star(_star(_contracted(edges), True), False).distinct(), f"{tag}-edges")
    raise RuntimeError("components did not settle")
