"""Connected components of an edge list: union-find inside partitions, star contraction between them.

Each round first replaces the edges of every partition by a forest of stars (node, smallest node it is connected to in that
partition), then joins every node's neighbours to its smallest neighbour. Edges shrink with every round; once they fit one
bounded task they are finished there. Between rounds edges are spread by both of their ends, so the star of a giant component
lies in as many tasks as its edges need. Nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.runtime import blocks_for, materialize

#: Edges that one task may finish alone (two arrays of 16 MB).
LOCAL_EDGES = 2_000_000
#: Edges of one partition between rounds.
PART_EDGES = 500_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges a - b."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        nodes, least = least_labels(t["a"].to_numpy(), t["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def spread(edges: DataFrame, rows: int, part_edges: int = PART_EDGES) -> DataFrame:
    """Edges in partitions of about equal size, whatever node they share."""
    return edges.repartition(blocks_for(rows, part_edges), F.xxhash64("a", "b"))


def _salted(best: DataFrame, jumps: DataFrame, rows: int, part_edges: int) -> DataFrame:
    """best (node, a) with a's own centre, where it has one, in place of a. A giant star's rows meet their one jump in several tasks."""
    salts = min(64, blocks_for(rows, part_edges))
    left = best.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    right = jumps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["a", "salt"], "left").select(F.coalesce("further", "a").alias("a"), F.col("node").alias("b"))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node. Self-loops are allowed.

    A round hooks centres that share a member onto the smallest of them and halves the way of every node to its last centre, so the
    number of rounds grows with the logarithm of the longest way."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    while True:
        forest = materialize(edges.mapInArrow(_stars, "node long, component long"), "forest")
        rows = forest.count()
        if rows <= local_edges:
            one = forest.select(F.col("node").alias("a"), F.col("component").alias("b")).coalesce(1)
            labels = one.mapInArrow(_stars, "node long, component long")
            break
        pairs = forest.filter("node <> component")
        best = materialize(pairs.groupBy("node").agg(F.min("component").alias("a")), "best")
        # a member of several stars joins their centres under the smallest
        joins = materialize(pairs.join(best, "node").filter("component <> a").select("a", F.col("component").alias("b")).distinct(), "joins")
        # centres that are members themselves: all they hold goes on to their own centre
        jumps = materialize(best.join(best.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.col("a").alias("further")), "jumps")
        if joins.isEmpty() and jumps.isEmpty():
            centres = best.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            labels = best.select("node", F.col("a").alias("component")).unionByName(centres)
            break
        edges = spread(_salted(best, jumps, rows, part_edges).unionByName(joins), rows, part_edges)
    return labels.unionByName(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
