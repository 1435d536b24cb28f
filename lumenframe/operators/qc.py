"""Quality control and balancing of a cell-by-gene matrix in long form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import sampling


def library_sizes(cells: DataFrame, counts: DataFrame, *, cell: str = "cell_id", value: str = "count") -> DataFrame:
    """Cells with library, the sum of their counts; 0 for cells without any."""
    sums = counts.groupBy(cell).agg(F.sum(value).alias("library"))
    return cells.join(sums, cell, "left").withColumn("library", F.coalesce("library", F.lit(0.0)))


def library_range(sized: DataFrame, *, low: float = 0.0, high: float | None = None, quantile: float | None = None) -> DataFrame:
    """Cells whose library is within low and high, or below the exact quantile, bounds included. ValueError without either."""
    if high is not None:
        return sized.where(F.col("library").between(low, high))
    if quantile is None:
        raise ValueError("either high or quantile must be given")
    bound = sized.agg(F.percentile("library", quantile).alias("high_"))  # one row
    return sized.join(F.broadcast(bound)).where((F.col("library") >= low) & (F.col("library") <= F.col("high_"))).drop("high_")


def at_least(df: DataFrame, group: str, fewest: int) -> DataFrame:
    """Rows of groups with so many rows or more. The sizes are few and combined before the shuffle; the rows are not moved."""
    sizes = df.groupBy(F.col(group).alias("g_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= fewest)
    return df.join(sizes, F.col(group) == F.col("g_"), "left_semi")


def qc_balance(sized: DataFrame, *, label: str, batch: str, key: str = "cell_id", protected: Column, low: float = 0.0, high: float, min_class: int, caps: Mapping[str, int], major: str, ratio: float, min_batch: int, seed: int = 0) -> DataFrame:
    """Library bounds for all (sized has library, see library_sizes); then, but for protected rows: class floor, caps, cut of the major class, batch floor.

    The bounded rows are written once, so what sized is made from is read once.  Floors and caps follow from one count of each
    label, and all cuts of a label take its first rows in one order, so each label has one limit and rows are ranked once.
    """
    scratch = Scratch(sized.sparkSession, "qc-balance")
    rows = library_range(sized, low=low, high=high).withColumn("protected_", F.coalesce(protected, F.lit(False)))
    rows = scratch.keep(rows, "bounded")
    free = rows.where("NOT protected_")
    # A row for each label from here to the join.
    sizes = free.groupBy(F.col(label).alias("label_")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_class)
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]) if caps else F.lit(None).cast("map<string,int>")
    sizes = sizes.withColumn("limit", F.least("n", F.coalesce(F.try_element_at(cap, F.col("label_")), F.col("n"))))
    target = F.floor(F.lit(ratio) * F.sum(F.when(F.col("label_") != major, F.col("limit")).otherwise(0)).over(Window.partitionBy(F.lit(1))))
    cut = (F.col("label_") == major) & (target > 0) & (F.col("limit") > target)
    limits = sizes.select("label_", F.when(cut, target).otherwise(F.col("limit")).alias("limit_"))
    ranked = sampling.hash_ranked(free, [label], key, seed, "n_")
    kept = ranked.join(limits, (F.col(label) == F.col("label_")) & (F.col("n_") <= F.col("limit_"))).drop("n_", "label_", "limit_")
    kept = at_least(scratch.keep(kept, "kept"), batch, min_batch)
    return kept.unionByName(rows.where("protected_")).drop("protected_")


def known_only(query: DataFrame, train: DataFrame, column: str) -> DataFrame:
    return query.join(train.select(column).distinct(), column, "left_semi")


def new_only(query: DataFrame, train: DataFrame, column: str) -> DataFrame:
    return query.join(train.select(column).distinct(), column, "left_anti")


def evaluable(df: DataFrame, true: str, training_classes: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Rows whose true label is known and one that was trained on."""
    return df.where(F.col(true) != unknown).join(training_classes.select(F.col(true)).distinct(), true, "left_semi")


def counted(df: DataFrame, *groups: str) -> DataFrame:
    """Rows with the size of their group."""
    return df.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*groups)))
