"""Distances between group centres, and what they say about far pairs and isolated groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import distance
from ..schema import numeric_order
from ..scratch import Scratch


def centroids(latent: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): mean of each dimension, in double precision. Dimensions are summed by position, combined before the shuffle."""
    long = latent.select(F.col(group).cast("string").alias("cluster"), F.posexplode(vector).alias("k", "x"))
    means = long.groupBy("cluster", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))


def _ordered_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a few groups, the first before the second in numeric order."""
    place = F.row_number().over(Window.orderBy(*numeric_order("cluster")))
    a = left.withColumn("at", place).select(*[F.col(c).alias(f"{c}_a") for c in [*left.columns, "at"]])
    b = right.withColumn("at", place).select(*[F.col(c).alias(f"{c}_b") for c in [*right.columns, "at"]])
    return a.join(F.broadcast(b), F.col("at_a") < F.col("at_b"))


def centroid_distances(latent: DataFrame, group: str, vector: str) -> DataFrame:
    """(cluster_a, cluster_b, latent_key, centroid_distance) of each pair of groups; groups are few, their rows are not."""
    centres = centroids(latent, group, vector)
    return _ordered_pairs(centres, centres).select("cluster_a", "cluster_b", F.lit(vector).alias("latent_key"), distance(F.col("centre_a"), F.col("centre_b")).alias("centroid_distance"))


def far_same_label(distances: DataFrame, labels: DataFrame, *, quantile: float = 0.9, active: Column | None = None, most: int | None = None) -> DataFrame:
    """Pairs of the same label, with the quantile of their distances as threshold and which of them reach it, farthest first."""
    a, b = (labels.select(F.col("cluster").alias(f"cluster_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    pairs = distances.join(a, "cluster_a").join(b, "cluster_b").where("label_a = label_b")
    if active is not None:
        pairs = pairs.where(active)
    threshold = F.percentile("centroid_distance", quantile).over(Window.partitionBy(F.lit(1)))
    out = pairs.select("cluster_a", "cluster_b", F.col("label_a").alias("label"), "centroid_distance", threshold.alias("threshold")).withColumn("selected", F.col("centroid_distance") >= F.col("threshold"))
    return out if most is None else out.where("selected").orderBy(F.desc("centroid_distance"), "cluster_a", "cluster_b").limit(most)


def novelty_score(far: Column, isolated: Column, alternative: Column) -> Column:
    return F.least(F.lit(5), 3 * far.cast("int") + 2 * isolated.cast("int") + alternative.cast("int"))


def novelty_evidence(distances: DataFrame, labels: DataFrame, *, distance_quantile: float = 0.9, isolation_quantile: float = 0.9, compat: bool = False) -> DataFrame:
    """For each group its nearest neighbour, how isolated that makes it, its nearest and farthest of the same label, flags and a score from 0 to 5.

    labels has cluster, label and alternative (null or '' for none).  The threshold for
    the farthest of the same label is the quantile over all same-label pairs; with
    compat it is that over the group's own, which its farthest always reaches.
    """
    scratch = Scratch(distances.sparkSession, "novelty")
    distances, labels = scratch.keep(distances, "distances"), scratch.keep(labels, "labels")
    both = distances.select(F.col("cluster_a").alias("cluster"), F.col("cluster_b").alias("other"), "centroid_distance").unionByName(distances.select(F.col("cluster_b").alias("cluster"), F.col("cluster_a").alias("other"), "centroid_distance"))
    mine = labels.select("cluster", "label", F.coalesce("alternative", F.lit("")).alias("alternative"))
    other = labels.select(F.col("cluster").alias("other"), F.col("label").alias("other_label"))
    rows = both.join(mine, "cluster").join(other, "other").withColumn("same", F.col("label") == F.col("other_label"))
    bounds = distances.agg(F.percentile("centroid_distance", isolation_quantile).alias("isolation_threshold"))
    far = far_same_label(distances, labels, quantile=distance_quantile).agg(F.max("threshold").alias("same_threshold"))
    d, o = F.col("centroid_distance"), F.col("other")
    near, away = F.struct("centroid_distance", "other"), F.struct(-d, o)
    same = lambda c: F.when(F.col("same"), c)
    out = rows.groupBy("cluster", "label", "alternative").agg(F.min(near).alias("near"), F.min(same(near)).alias("near_same"), F.min(same(away)).alias("far_same"), F.percentile(same(d), distance_quantile).alias("own_threshold"))
    # The share of all distances up to a group's nearest one, from the counts of distinct distances in order.
    counts = distances.groupBy(F.col("centroid_distance").alias("d_")).agg(F.count(F.lit(1)).alias("n_"))
    every = Window.partitionBy(F.lit(1))
    shares = counts.select("d_", (F.sum("n_").over(every.orderBy("d_")) / F.sum("n_").over(every)).alias("isolation_percentile"))
    out = out.join(shares, F.col("near.centroid_distance") == F.col("d_")).join(F.broadcast(bounds)).join(F.broadcast(far))  # one row each
    farthest = -F.col("far_same.col1")
    out = out.select(
        "cluster",
        "label",
        "alternative",
        F.col("near.other").alias("nearest_cluster"),
        F.col("near.centroid_distance").alias("nearest_distance"),
        "isolation_percentile",
        (F.col("near.centroid_distance") >= F.col("isolation_threshold")).alias("isolation_flag"),
        F.col("near_same.other").alias("nearest_same_label_cluster"),
        F.col("near_same.centroid_distance").alias("nearest_same_label_distance"),
        F.col("far_same.other").alias("farthest_same_label_cluster"),
        farthest.alias("farthest_same_label_distance"),
        F.coalesce(farthest >= F.col("own_threshold" if compat else "same_threshold"), F.lit(False)).alias("same_label_distance_flag"),
    )
    return out.withColumns({"possible_novel_subtype": F.col("same_label_distance_flag") | F.col("isolation_flag"), "novelty_score": novelty_score(F.col("same_label_distance_flag"), F.col("isolation_flag"), F.col("alternative") != "")}).drop("alternative")
