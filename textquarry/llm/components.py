"""Connected components by contraction, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to so many links (16 bytes each) are joined by one task; more are contracted by all.
ONE_TASK = 1_000_000


def _union(batches):
    """Union-find over the links of one task, roots being the smallest nodes."""
    parts = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1) for b in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict({"node": nodes, "label": nodes[[root(i) for i in range(len(nodes))]]})


def _roots(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """``parent`` (node, up) with every node's root as ``up``, by doubling: log2 of the longest way to a root steps."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = scratch.keep(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        still = jumped.where("moved").isEmpty()
        scratch.drop(scratch.n - 1)
        parent = jumped.drop("moved")
        if still:
            return parent


def contract(links: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``links`` has long columns ``a`` and ``b``. Where there are more than
    ``one_task`` of them, each round hooks every node to its smallest neighbour
    (or itself), goes up to the roots, renames the links and drops those that
    became loops; the rounds end when no link is left. A root of one round has
    a smaller neighbour in the next unless it has taken in all its neighbours,
    so two rounds leave half the nodes at most. Returns ``node, label``. A hub
    with many links only costs partial sums: each round aggregates with
    map-side combining, and skewed joins are left to adaptive execution.
    """
    links = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.count() <= one_task:
        return scratch.keep(links.coalesce(1).mapInArrow(_union, "node long, label long"))
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        parent = _roots(scratch.keep(ends.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("up"))), scratch)
        if labels is None:
            renamed = parent.select("node", F.col("up").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), "up")
            renamed = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = scratch.keep(renamed)
        a = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        links = scratch.keep(
            links.join(a, "a").join(b, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
        if links.isEmpty():
            return labels
