"""Expression of genes: normalised counts, group means, shares of cells, fold changes, scaled plot data. Zeros are not stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def normalise(counts: DataFrame, *, cell: str = "cell_id", value: str = "count", total: float = 1e4) -> DataFrame:
    """counts with norm, scaled so that a cell adds up to total, and x, its log of one more. A cell's counts share a partition."""
    library = F.sum(value).over(Window.partitionBy(cell))
    return counts.withColumn("norm", F.col(value) / library * total).withColumn("x", F.log1p("norm"))


def group_sizes(cells: DataFrame, group: str) -> DataFrame:
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))


def per_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row once for each group, with the group's columns: as many rows as the result of a table by group has. The groups, a row for
    each, go along as one list, and not as a table that every row would be compared with."""
    listed = groups.agg(F.collect_list(F.struct("*")).alias("groups_"))  # one row
    return rows.join(F.broadcast(listed)).select(*[F.col(f"`{c}`") for c in rows.columns], F.explode("groups_").alias("group_")).select(*[F.col(f"`{c}`") for c in rows.columns], "group_.*")


def group_means(expressed: DataFrame, cells: DataFrame, group: str, *, gene: str = "gene", cell: str = "cell_id", value: str = "x") -> DataFrame:
    """(group, gene, mean, pct): mean over all cells of the group, zeros included, and the share of cells that have the gene."""
    sums = expressed.join(cells.select(cell, group), cell).groupBy(group, gene).agg(F.sum(value).alias("s_"), F.count(F.lit(1)).alias("nz_"))
    return sums.join(group_sizes(cells, group), group).select(group, gene, (F.col("s_") / F.col("n_cells")).alias("mean"), (F.col("nz_") / F.col("n_cells")).alias("pct"))


def fold_changes(expressed: DataFrame, cells: DataFrame, group: str, *, gene: str = "gene", cell: str = "cell_id", pseudo: float = 1e-9) -> DataFrame:
    """(group, gene, logfc, pct_group, pct_rest): log2 ratio of the de-logged means in the group and outside, with a pseudo-count."""
    scratch = Scratch(expressed.sparkSession, "fold-changes")
    sums = scratch.keep(expressed.join(cells.select(cell, group), cell).groupBy(group, gene).agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("nz")), "sums")
    sizes = scratch.keep(group_sizes(cells, group), "sizes")
    total = sizes.agg(F.sum("n_cells").alias("all_cells"))
    genes = sums.groupBy(gene).agg(F.sum("s").alias("s_all"), F.sum("nz").alias("nz_all")).join(F.broadcast(total))  # one row
    at = per_group(genes, sizes).join(sums, [group, gene], "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "nz": F.coalesce("nz", F.lit(0))})
    rest = F.col("all_cells") - F.col("n_cells")
    mine, other = F.col("s") / F.col("n_cells"), (F.col("s_all") - F.col("s")) / F.nullif(rest, F.lit(0))
    return at.select(group, gene, F.log2((F.expm1(mine) + pseudo) / (F.expm1(other) + pseudo)).alias("logfc"), (F.col("nz") / F.col("n_cells")).alias("pct_group"), ((F.col("nz_all") - F.col("nz")) / F.nullif(rest, F.lit(0))).alias("pct_rest"))


def scaled_by_gene(means: DataFrame, *, gene: str = "gene", value: str = "mean") -> DataFrame:
    """means with scaled: 0 to 1 within each gene, 0 if all are equal."""
    w = Window.partitionBy(gene)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return means.withColumn("scaled", F.coalesce((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))
