"""Attribution of a linear classifier's scores to genes, and selections from the ranked tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary


def linear_attribution(expressed: DataFrame, selected: DataFrame, weights: DataFrame, baseline: DataFrame | None = None, *, cell: str = "cell_id", gene: str = "gene", state: str = "state", value: str = "x") -> DataFrame:
    """(state, gene, mean_attr, mean_abs_attr, n_cells): (x - baseline) * weight, which integrated gradients come to for a linear score.

    Zeros are not stored: cells without a gene add -baseline * weight each.
    """
    sizes = selected.groupBy(state).agg(F.count(F.lit(1)).alias("n_cells"))
    base = weights.select(gene).distinct().withColumn("b", F.lit(0.0)) if baseline is None else baseline.select(gene, F.col("baseline").alias("b"))
    grid = weights.join(base, gene).join(sizes, state)
    have = expressed.join(selected.select(cell, state), cell).join(base, gene).groupBy(state, gene).agg(F.sum(F.col(value) - F.col("b")).alias("s"), F.sum(F.abs(F.col(value) - F.col("b"))).alias("a"), F.count(F.lit(1)).alias("nz"))
    at = grid.join(have, [state, gene], "left").na.fill(0, ["s", "a", "nz"])
    zeros = F.col("n_cells") - F.col("nz")
    return at.select(state, gene, ((F.col("s") - zeros * F.col("b")) * F.col("weight") / F.col("n_cells")).alias("mean_attr"), ((F.col("a") + zeros * F.abs("b")) * F.abs("weight") / F.col("n_cells")).alias("mean_abs_attr"), "n_cells")


def ranked(attr: DataFrame, *, state: str = "state", gene: str = "gene") -> DataFrame:
    """Ranks within a state by mean_abs_attr, and the direction of the mean."""
    order = Window.partitionBy(state).orderBy(F.desc("mean_abs_attr"), gene)
    return attr.withColumns({"rank": F.row_number().over(order), "direction": F.when(F.col("mean_attr") >= 0, F.lit("positive")).otherwise(F.lit("negative"))})


def wide(table: DataFrame, states: Sequence[str], *, state: str = "state", gene: str = "gene") -> DataFrame:
    """A row for each gene: value and rank in each state, and the mean of its ranks. One pivot instead of a join for each state."""
    out = table.groupBy(gene).pivot(state, list(states)).agg(F.first("mean_abs_attr").alias("attr"), F.first("rank").alias("rank"))
    ranks = [F.col(f"`{s}_rank`").cast("double") for s in states]
    present = F.filter(F.array(*ranks), lambda r: r.isNotNull())
    return out.withColumn("mean_rank", F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0)))


def broad_gene(gene: Column) -> Column:
    """Genes expressed everywhere, whatever their case."""
    up = F.upper(gene)
    return up.isin(*vocabulary.BROAD_GENES) | up.rlike("^(" + "|".join(vocabulary.BROAD_PREFIXES) + ")")


def relative_to_top(table: DataFrame, *, share: float = 0.01, fewest: int = 10, most: int = 50, state: str = "state") -> DataFrame:
    """The first genes of each state: as many as reach share of its largest value, within fewest and most; with their share of the total so far."""
    by = Window.partitionBy(state)
    order = by.orderBy("rank")
    v = F.col("mean_abs_attr")
    at = table.withColumns({"top_": F.max(v).over(by), "total_": F.sum(v).over(by), "so_far_": F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    reach = F.sum((v >= share * F.col("top_")).cast("int")).over(by)
    at = at.withColumn("n_selected", F.least(F.greatest(reach, F.lit(fewest)), F.lit(most), F.count(F.lit(1)).over(by)))
    return at.where(F.col("rank") <= F.col("n_selected")).withColumn("cumulative_share", F.col("so_far_") / F.nullif(F.col("total_"), F.lit(0.0))).drop("top_", "total_", "so_far_")


def strongest_state(table: DataFrame, *, state: str = "state", gene: str = "gene") -> DataFrame:
    """(gene, state, value): the state in which each gene weighs most, of equals the first."""
    out = table.groupBy(gene).agg(F.min_by(F.struct(state, "mean_abs_attr"), F.struct(-F.col("mean_abs_attr"), F.col(state))).alias("m"))
    return out.select(gene, F.col(f"m.{state}").alias(state), F.col("m.mean_abs_attr").alias("value"))


def selected_cells(predictions: DataFrame, state: str, *, label: str = "label", predicted: str = "pred_label", confidence: str = "confidence", least: float = 0.70) -> DataFrame:
    """Cells that are of the state, are predicted to be, and surely enough."""
    return predictions.where((F.col(label) == state) & (F.col(predicted) == state) & (F.col(confidence) >= least))
