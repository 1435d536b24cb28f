"""Which rows, states and columns a run works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling


def included(df: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is among include (all, if it is empty) and not among exclude; null is in neither."""
    c = F.col(column).cast("string")
    if include:
        df = df.where(c.isin(*include))
    return df.where(~F.coalesce(c.isin(*exclude), F.lit(False))) if exclude else df


def filter_suffix(known_only: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> str:
    """The part of an output's name that tells its filters."""
    parts = ["known_assays_only"] * known_only + [f"{name}_{'_'.join(values)}" for name, values in (("include", include), ("exclude", exclude)) if values]
    return "".join(f"_{p}" for p in parts)


def target_states(labels: DataFrame, label: str, known: DataFrame, *, asked: Sequence[str] = (), defaults: Sequence[str] = (), unknown: str = "Unknown") -> DataFrame:
    """(state, found): the states asked for (texts of one or more, parted by commas), else all labels but unknown, else defaults; found if known (state) has them."""
    spark = labels.sparkSession
    names = list(dict.fromkeys(x.strip() for text in asked for x in text.split(",") if x.strip()))
    if names:
        states = spark.createDataFrame([(x,) for x in names], "state string")
    else:
        states = labels.select(F.col(label).alias("state")).where((F.col(label) != unknown) & F.col(label).isNotNull()).distinct()
        if defaults and states.isEmpty():
            states = spark.createDataFrame([(x,) for x in dict.fromkeys(defaults)], "state string")
    return states.join(known.select(F.col("state").alias("k_")).distinct(), F.col("state") == F.col("k_"), "left").select("state", F.col("k_").isNotNull().alias("found"))


def encoded(df: DataFrame, column: str, registry: Sequence[str], to: str) -> DataFrame:
    """The place of each value in the registry, from 0. ValueError names all values, in order, that it lacks."""
    c = F.col(column)
    missing = df.where(c.isNull() | ~c.isin(*registry)).agg(F.sort_array(F.collect_set(F.coalesce(c.cast("string"), F.lit("null")))).alias("v")).first().v
    if missing:
        raise ValueError(f"{column}: not in the registry: {', '.join(missing)}")
    return df.withColumn(to, F.array_position(F.lit(list(registry)), c).cast("int") - 1)


def plot_points(df: DataFrame, label: str, key: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """The points of a figure: all, or about most of them, of each label its share."""
    return df if most is None else sampling.proportional_sample(df, label, key, most, seed)


def provenance(df: DataFrame, column: str, source: str, *, copy: str | None = None) -> DataFrame:
    """df with a tag that says where a column is from, and a copy of it as it was."""
    return df.withColumns({copy or f"{column}_original": F.col(column), f"{column}_source": F.lit(source)})


def size_class(n: Column, *, hard: int, warn: int) -> Column:
    """The class by which a bar of a batch profile is coloured."""
    return F.when(n < hard, F.lit("too_small")).when(n < warn, F.lit("small")).otherwise(F.lit("stable"))


def clean_scalar(c: Column) -> Column:
    """A number as JSON can hold it: none for NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def with_predictions(cells: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Cells with their predictions; cells without any stay."""
    return cells.join(predictions, key, "left")


def in_all(key: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of the first table whose key all others have."""
    for other in others:
        first = first.join(other.select(key).distinct(), key, "left_semi")
    return first
