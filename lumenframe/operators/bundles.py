"""Metrics of a run together: of splits, of a latent space, of strategies, and kept results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import classify, graph, nearest_index, neighbors, sampling


def split_summary(predictions: DataFrame, splits: Mapping[str, Column], *, true: str, predicted: str, training: DataFrame | None = None, unknown: str = "Unknown", fewest: int = 30) -> DataFrame:
    """(split, macro_f1, weighted_f1, n_rows, dropped_unseen, dropped_rare): a row for each part of the predictions; labels left out are listed, joined by semicolons."""

    def one(name: str, part: DataFrame) -> DataFrame:
        known = part.where(F.col(true) != unknown)
        seen = known if training is None else known.join(training.select(true).distinct(), true, "left_semi")
        names = lambda df: F.array_join(F.sort_array(F.collect_set(df)), ";")
        unseen = known.select(true).distinct().join(seen.select(F.col(true).alias("s_")).distinct(), F.col(true) == F.col("s_"), "left_anti").agg(names(true).alias("dropped_unseen"))
        rare = seen.groupBy(true).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") < fewest).agg(names(true).alias("dropped_rare"))
        rows = classify.scored_rows(part, true, by=[], training=training, unknown=unknown, fewest=fewest)
        out = classify.summary(classify.per_class(rows, true, predicted))
        return out.join(F.broadcast(unseen)).join(F.broadcast(rare)).select(F.lit(name).alias("split"), "macro_f1", "weighted_f1", "n_rows", "dropped_unseen", "dropped_rare")  # one row each

    return reduce(DataFrame.unionByName, [one(name, predictions.where(rows)) for name, rows in splits.items()])


def f1_of_all_classes(predictions: DataFrame, *, true: str, predicted: str) -> DataFrame:
    """(macro_f1, weighted_f1, n_classes, n_rows) over all classes that are true or predicted anywhere."""
    return classify.summary(classify.per_class(predictions, true, predicted, predicted_only=True))


def _sampled(points: DataFrame, label: str, key: str, most: int, unknown: str, seed: int) -> DataFrame:
    """The sample, written once: every metric reads it."""
    return Scratch(points.sparkSession, "metrics").keep(sampling.proportional_sample(points.where(F.col(label) != unknown), label, key, most, seed), "sample")


def _near(points: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """The k nearest of each point, written once: every metric on neighbours reads them."""
    return Scratch(points.sparkSession, "metrics").keep(nearest_index.nearest_of_all(points, k, key=key, vector=vector), "near")


def _one_row(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(F.broadcast(b)), tables)  # one row each


def integration_metrics(points: DataFrame, name: str, *, label: str, batch: str, key: str = "id", vector: str = "z", k: int = 30, resolution: float = 1.0, most: int = 50_000, unknown: str = "Unknown", seed: int = 0) -> DataFrame:
    """One row: silhouettes of labels and batches, connectivity, neighbour votes, and how communities agree with labels, on one sample. ilisi_batch is never measured."""
    p = _sampled(points, label, key, most, unknown, seed)
    near = _near(p, k, key, vector)
    found = graph.communities(graph.fuzzy_graph(near, k + 1, key=key), [resolution])
    agreed = classify.agreement(p.select(key, label).join(found.select(F.col("node").alias(key), "cluster"), key), label, "cluster")
    size = p.agg(F.count(F.lit(1)).alias("n_cells_metric"), F.count_distinct(batch).alias("n_batches_metric"))
    out = _one_row(size, neighbors.label_asw(p, label, key=key, vector=vector), neighbors.batch_asw(p, label, batch, key=key, vector=vector), neighbors.graph_connectivity(p, k, label, key=key, vector=vector, near=near), neighbors.label_accuracy(p, k, label, key=key, vector=vector, near=near), agreed)
    return out.select(F.lit(name).alias("strategy"), "n_cells_metric", "n_batches_metric", "label_asw", "batch_asw", "graph_connectivity", "knn_label_accuracy", "nmi", "ari", F.lit(None).cast("double").alias("ilisi_batch"))


def strategy_metrics(points: DataFrame, *, label: str, batches: Mapping[str, str], key: str = "id", vector: str = "z", k: int = 30, most: int = 50_000, unknown: str = "Unknown", seed: int = 0) -> DataFrame:
    """One row: of a latent space the sample's size, what tells its labels, and for each batch column (name: column) the number of batches, mixing, votes and their baseline."""
    p = _sampled(points, label, key, most, unknown, seed)
    parts = [p.agg(F.count(F.lit(1)).alias("n_cells_metric"), *[F.count_distinct(c).alias(f"n_{name}s_metric") for name, c in batches.items()])]
    near = _near(p, k, key, vector)
    parts += [neighbors.label_asw(p, label, key=key, vector=vector), neighbors.graph_connectivity(p, k, label, key=key, vector=vector, near=near), neighbors.label_accuracy(p, k, label, key=key, vector=vector, near=near)]
    for name, c in batches.items():
        parts.append(neighbors.batch_asw(p, label, c, key=key, vector=vector).withColumnRenamed("batch_asw", f"{name}_asw_mixing"))
        parts.append(neighbors.within_label_batch_accuracy(p, k, label, c, key=key, vector=vector).withColumnRenamed("knn_batch_accuracy", f"{name}_knn_batch_acc"))
        parts.append(classify.majority_baseline(p, label, c).withColumnRenamed("baseline", f"{name}_knn_baseline_acc"))
    return _one_row(*parts)


def kept(spark: SparkSession, folder: str, settings: Mapping[str, object], make: Callable[[], DataFrame], *, needed: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """The result that a run with these settings has left in a folder, or else made now and left there; made again where a needed column is missing, or by force."""
    path = f"{folder}/{settings_name(settings)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        found = spark.read.parquet(path)
        if set(needed) <= set(found.columns):
            return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settings_name(settings: Mapping[str, object]) -> str:
    """A folder's name that tells settings apart."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
