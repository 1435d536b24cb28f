"""Nearest neighbours, silhouettes and connectivity of labelled points.

These metrics are defined on a bounded sample of points (see sampling.proportional_sample), so the sample is sent to
every task, after a check of its size; tasks take blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The most points that are sent to every task.
MOST_POINTS = 50_000
#: Points that a task compares with all others at a time, at most, and distances that it holds then.
BLOCK, HELD = 128, 1 << 20


def _sample(points: DataFrame, key: str, vector: str, *labels: str) -> tuple[np.ndarray, ...]:
    """Keys in order, vectors, and numbers of the labels' values, of a sample of bounded size."""
    rows = points.select(key, vector, *labels).limit(MOST_POINTS + 1).toArrow()
    if rows.num_rows > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points: take a sample first")
    order = np.argsort(rows[key].to_numpy(), kind="stable")
    if not len(order):
        return np.zeros(0, np.int64), np.zeros((0, 0)), *(np.zeros(0, np.int64) for _ in labels)
    codes = [np.unique(np.array(rows[c].to_pylist(), str), return_inverse=True)[1][order] for c in labels]
    return rows[key].to_numpy()[order], np.array(rows[vector].to_pylist(), float)[order], *codes


def _rows(n: int) -> int:
    """So many points are compared with n others at a time that a task's memory does not grow with n."""
    return max(1, min(BLOCK, HELD // max(1, n)))


def _squared(q: np.ndarray, x: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + squares[None, :] - 2 * q @ x.T, 0.0)


def _by_group(own: np.ndarray, ids: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of own, places in the sample) of each group that has some: points are compared with those of their own group, and no others."""
    code = of[np.minimum(np.searchsorted(ids, own), len(ids) - 1)]
    for c in np.unique(code):
        yield np.flatnonzero(code == c), np.flatnonzero(of == c)


def nearest(points: DataFrame, k: int, *, key: str = "id", vector: str = "z", within: str | None = None) -> DataFrame:
    """(key, neighbour, rank, distance) of the k nearest other points (of the same value of within, if it is named), self left out by key; of equals the smaller key first."""
    ids, x, *of = _sample(points, key, vector, *([within] if within else []))
    shared = points.sparkSession.sparkContext.broadcast((ids, x, of[0] if within else np.zeros(len(ids), np.int64)))

    def work(batches):
        ids, x, of = shared.value
        squares = (x * x).sum(1)
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(1)
            for rows, there in _by_group(own, ids, of):
                names, others, theirs, block = ids[there], x[there], squares[there], _rows(len(there))
                n = min(k, len(there) - 1)
                if n < 1:
                    continue
                for a in range(0, len(rows), block):
                    mine = own[rows[a : a + block]]
                    q = np.array(at.take(pa.array(rows[a : a + block])).to_pylist(), float)
                    rough = _squared(q, others, theirs)
                    rough[names[None, :] == mine[:, None]] = np.inf
                    # Candidates by the fast form, with room for its rounding; their order by exact differences.
                    cut = np.partition(rough, n - 1, axis=1)[:, n - 1]
                    who, near, rank, far = [], [], [], []
                    for r in range(len(q)):
                        some = np.flatnonzero((rough[r] <= cut[r] + 1e-6 * (1 + abs(cut[r]))) & np.isfinite(rough[r]))
                        d = np.sqrt(((others[some] - q[r]) ** 2).sum(1))
                        first = np.lexsort((names[some], d))[:n]
                        who.append(np.full(len(first), mine[r]))
                        near.append(names[some][first])
                        rank.append(np.arange(1, len(first) + 1))
                        far.append(d[first])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (who, near, rank, far)], names=[key, "neighbour", "rank", "distance"])

    return points.select(F.col(key).cast("long"), vector).mapInArrow(work, f"{key} long, neighbour long, rank long, distance double")


def _voted(points: DataFrame, k: int, label: str, key: str, vector: str, near: DataFrame | None) -> DataFrame:
    """(key, label, vote): the most frequent label of the k nearest, of equals the smallest."""
    near = nearest(points, k, key=key, vector=vector) if near is None else near.where(F.col("rank") <= k)
    theirs = points.select(F.col(key).alias("neighbour"), F.col(label).alias("their"))
    votes = near.join(theirs, "neighbour").groupBy(key).agg(F.mode("their", True).alias("vote"))
    return points.select(key, label).join(votes, key)


def label_accuracy(points: DataFrame, k: int, label: str, *, key: str = "id", vector: str = "z", near: DataFrame | None = None) -> DataFrame:
    """One row: the share of points that the vote of their k nearest gets right; null below two labels or at k points or fewer. near are neighbours found before."""
    out = _voted(points, k, label, key, vector, near).agg(F.avg((F.col("vote") == F.col(label)).cast("double")).alias("acc"))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels"))
    return out.join(F.broadcast(size)).select(F.when((F.col("labels") >= 2) & (F.col("n") > k), F.col("acc")).alias("knn_label_accuracy"))


def within_label_batch_accuracy(points: DataFrame, k: int, label: str, batch: str, *, key: str = "id", vector: str = "z") -> DataFrame:
    """One row: votes on the batch among the points of a label, averaged by size over labels with more than k + 1 points and two batches."""
    near = nearest(points, k, key=key, vector=vector, within=label)
    theirs = points.select(F.col(key).alias("neighbour"), F.col(batch).alias("their"))
    votes = near.join(theirs, "neighbour").groupBy(key).agg(F.mode("their", True).alias("vote"))
    counted = points.groupBy(F.col(label).alias("l_")).agg(F.count(F.lit(1)).alias("n_"), F.count_distinct(batch).alias("b_")).where((F.col("n_") > k + 1) & (F.col("b_") >= 2))
    rows = points.select(key, F.col(label).alias("l_"), batch).join(counted, "l_").join(votes, key)
    return rows.agg(F.avg((F.col("vote") == F.col(batch)).cast("double")).alias("knn_batch_accuracy"))


def mixing_score(accuracy: Column, baseline: Column) -> Column:
    """1 if the batch cannot be told better than by its share, 0 if always; null for null."""
    above = F.greatest(F.lit(0.0), accuracy - baseline) / (1 - baseline)
    mixed = F.when(baseline >= 1, (accuracy <= baseline).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - above)))
    return F.when(accuracy.isNotNull() & baseline.isNotNull(), mixed)


def silhouettes(points: DataFrame, label: str, *, key: str = "id", vector: str = "z", within: str | None = None) -> DataFrame:
    """(key, label, s): silhouette of each point, Euclidean, among the points of the same value of within if it is named; 0 for a label of one
    point, or where there is no other label. Sums of distances to each label are made block by block."""
    ids, x, of, *inside = _sample(points, key, vector, label, *([within] if within else []))
    shared = points.sparkSession.sparkContext.broadcast((ids, x, of, inside[0] if within else np.zeros(len(ids), np.int64)))

    def work(batches):
        ids, x, of, inside = shared.value
        squares = (x * x).sum(1)
        # A group is a label within a value of within; points are compared with the groups of their own value.
        groups, code = np.unique(np.stack([inside, of]), axis=1, return_inverse=True) if len(ids) else (np.zeros((2, 0), np.int64), of)
        sizes = np.bincount(code, minlength=groups.shape[1])
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(1)
            for rows, there in _by_group(own, ids, inside):
                names, others, theirs, block = ids[there], x[there], squares[there], _rows(len(there))
                own_groups = np.unique(code[there])
                size, member = sizes[own_groups], (code[there][:, None] == own_groups[None, :]).astype(float)
                for a in range(0, len(rows), block):
                    part = pa.array(rows[a : a + block])
                    q = np.array(at.take(part).to_pylist(), float)
                    me, every = np.searchsorted(names, own[rows[a : a + block]]), np.arange(len(part))
                    d = np.sqrt(_squared(q, others, theirs))
                    d[every, me] = 0.0
                    sums, c = d @ member, np.searchsorted(own_groups, code[there][me])
                    mean = sums / size
                    mine = sums[every, c] / np.maximum(size[c] - 1, 1)
                    mean[every, c] = np.inf
                    other = mean.min(1)
                    top = np.maximum(mine, other)
                    s = np.where((size[c] < 2) | ~np.isfinite(other) | (top <= 0), 0.0, (other - mine) / np.where(np.isfinite(top) & (top > 0), top, 1.0))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(2).take(part), pa.array(s)], names=[key, label, "s"])

    return points.select(F.col(key).cast("long"), vector, label).mapInArrow(work, f"{key} long, {label} {points.schema[label].dataType.simpleString()}, s double")


def label_asw(points: DataFrame, label: str, *, key: str = "id", vector: str = "z") -> DataFrame:
    """One row: mean silhouette, moved to 0..1; null below two labels."""
    out = silhouettes(points, label, key=key, vector=vector).agg(F.avg("s").alias("s"), F.count_distinct(label).alias("labels"))
    return out.select(F.when(F.col("labels") >= 2, (F.col("s") + 1) / 2).alias("label_asw"))


def batch_asw(points: DataFrame, label: str, batch: str, *, key: str = "id", vector: str = "z", fewest: int = 10) -> DataFrame:
    """One row: 1 - |mean silhouette of batches| within each label, averaged by size; batches of one point and labels below fewest are left out."""
    l, b = F.col(label).alias("l_"), F.col(batch).alias("b_")  # noqa: E741
    enough = points.groupBy(l).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= max(fewest, 3)).select("l_")
    pairs = points.groupBy(l, b).agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 2").join(enough, "l_", "left_semi")
    left = pairs.groupBy("l_").agg(F.sum("n_").alias("n_"), F.count(F.lit(1)).alias("k_")).where((F.col("n_") >= fewest) & (F.col("k_") >= 2)).select("l_")
    kept = points.withColumns({"l_": F.col(label), "b_": F.col(batch)}).join(pairs.join(left, "l_", "left_semi").select("l_", "b_"), ["l_", "b_"], "left_semi")
    s = silhouettes(kept, batch, key=key, vector=vector, within=label).select(F.col(key).alias("k_"), "s")
    by = kept.join(s, F.col(key) == F.col("k_")).groupBy("l_").agg((1 - F.abs(F.avg("s"))).alias("score"), F.count(F.lit(1)).alias("n_"))
    return by.agg((F.sum(F.col("n_") * F.col("score")) / F.sum("n_")).alias("batch_asw"))


def graph_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), component being the smallest node reachable. Each round is written in the shared folder."""
    scratch = Scratch(edges.sparkSession, "graph")
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("least"))
        up = least.select(F.col("node").alias("least"), F.col("least").alias("far"))
        now = scratch.keep(least.join(up, "least", "left").select("node", F.least("least", F.coalesce("far", "least")).alias("now"), "component"), "labels")
        changed = not now.where("now <> component").isEmpty()
        labels = now.select("node", F.col("now").alias("component"))
        if not changed:
            return labels


def graph_connectivity(points: DataFrame, k: int, label: str, *, key: str = "id", vector: str = "z", near: DataFrame | None = None) -> DataFrame:
    """One row: for each label of three points or more the share of its largest component in the graph of near neighbours, averaged; null below five points. near are neighbours found before."""
    near = nearest(points, k, key=key, vector=vector) if near is None else near.where(F.col("rank") <= k)
    l1, l2 = (points.select(F.col(key).alias(c), F.col(label).alias(f"l_{c}")) for c in ("a", "b"))
    inside = near.select(F.col(key).alias("a"), F.col("neighbour").alias("b")).join(l1, "a").join(l2, "b").where("l_a = l_b")
    found = graph_components(inside.select("a", "b"))
    named = points.select(F.col(key).alias("node"), F.col(label).alias("l")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("l", "component").agg(F.count(F.lit(1)).alias("n"))
    by = sizes.groupBy("l").agg((F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    all_points = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return by.withColumn("all", all_points).where("n >= 3 AND all >= 5").agg(F.avg("share").alias("graph_connectivity"))
