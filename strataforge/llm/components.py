"""Connected components of links, by hooking and pointer jumping on tables.

A round hooks every node to its smallest smaller neighbour, shortens the
pointers until they reach roots, and carries the links over to the roots; each
round at least halves the nodes that still have links.  All joins read written
tables through plain exchanges, so that Spark can split a node with very many
links; minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


class Forest:
    """Union-find over arbitrary integers; the root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _spanning(batches):
    """Of the links that one task reads, a batch at a time, a spanning forest."""
    for batch in batches:
        forest = Forest()
        rows = [(max(a, b), min(a, b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if forest.join(a, b)]
        got = np.array(rows, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is the smallest reachable node."""
    edges = materialize(
        links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_spanning, "a long, b long").distinct(),
        "edges",
    )
    labels: DataFrame | None = None
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy("a").agg(F.min("b").alias("r")), "hooks")
        while True:
            up = hooks.select(F.col("a").alias("x"), F.col("r").alias("y"))
            step = materialize(hooks.join(up, hooks.r == up.x, "left").select("a", F.coalesce("y", "r").alias("r"), F.col("y").isNotNull().alias("moved")), "jumps")
            discard(hooks)
            hooks = step
            if step.where("moved").isEmpty():
                break
        left = hooks.select(F.col("a").alias("x"), F.col("r").alias("rx"))
        right = hooks.select(F.col("a").alias("y"), F.col("r").alias("ry"))
        moved = materialize(edges.join(left, edges.a == left.x).select("rx", "b"), "moved")
        # links whose root is their own other end are done; the rest is one row for each root and node, however many links that node has
        open_ones = moved.where("rx <> b").distinct()
        lifted = open_ones.join(right, open_ones.b == right.y, "left").select("rx", F.coalesce("ry", "b").alias("ry")).where("rx <> ry")
        lifted = materialize(lifted.select(F.greatest("rx", "ry").alias("a"), F.least("rx", "ry").alias("b")).distinct(), "edges")
        if labels is None:
            # nodes without a smaller neighbour stand for themselves so far
            roots = edges.select(F.col("b").alias("node")).distinct().join(hooks.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
            labels = materialize(hooks.select(F.col("a").alias("node"), F.col("r").alias("component")).unionByName(roots), "labels")
        else:
            later = hooks.select(F.col("a").alias("x"), F.col("r").alias("y"))
            labels = materialize(labels.join(later, labels.component == later.x, "left").select("node", F.coalesce("y", "component").alias("component")), "labels")
        discard(moved)
        discard(edges)
        edges = lifted
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
