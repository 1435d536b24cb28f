"""Connected components of an edge table, by repeated minimum labels with shortcuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Forest:
    """Union-find over the nodes a task has met, to pass on at most one edge for each node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (up := parent.setdefault(r, r)) != r:
            r = up
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of each node that is no root; the forest is empty afterwards."""
        pairs = [(x, r) for x in self.parent if (r := self.root(x)) != x]
        self.parent = {}
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]


def link_rows(forest: Forest, left: np.ndarray, right: np.ndarray, hits: np.ndarray) -> None:
    """Join left[i] with right[j] wherever hits[i, j], with about as many joins as there are nodes and not as many as hits."""
    label = np.arange(len(right))
    for i in np.flatnonzero(hits.any(1)).tolist():
        js = np.flatnonzero(hits[i])
        of = label[js]
        first = of[0]
        forest.join(int(left[i]), int(right[js[0]]))
        if (of != first).any():
            other = np.unique(of[of != first])
            for j in np.unique(of, return_index=True)[1].tolist():
                forest.join(int(left[i]), int(right[js[j]]))
            label[np.isin(label, other)] = first


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Each round, every node takes the smallest label among its own and its neighbours',
    and then the label of that label.  A round is written, so no lineage grows and a
    lost executor costs no earlier round.  Minima are combined before they are shuffled;
    joins on a node of many edges are plain ones, which AQE splits.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("least"))
        least = scratch.keep(least, "least")
        far = least.select(F.col("node").alias("least"), F.col("least").alias("far"))
        now = scratch.keep(least.join(far, "least", "left").select("node", F.coalesce(F.least("far", "least"), "least").alias("now"), F.col("label").alias("was")), "labels")
        scratch.drop(labels, least)
        labels = now.select("node", F.col("now").alias("label"))
        labels._scratch_path = now._scratch_path
        if now.where("now <> was").isEmpty():
            scratch.drop(both)
            return labels.withColumnRenamed("label", "component")
