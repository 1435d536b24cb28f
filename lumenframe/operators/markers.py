"""Marker genes: rank-sum tests on sparse counts, adjusted p values, top tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import two_sided_normal
from ..scratch import Scratch
from .expression import per_group


#: Values are cut into slices of this width, so that a gene's values are never ranked by one task together.
SLICES_PER_UNIT = 16


def _value_counts(expressed: DataFrame, cells: DataFrame, by: list[str], group: str, gene: str, cell: str, value: str, digits: int) -> DataFrame:
    have = expressed.join(cells.select(cell, *by, group), cell).select(*by, group, gene, F.round(value, digits).alias("v"), F.col(value).alias("x_"))
    return have.groupBy(*by, gene, "v", group).agg(F.count(F.lit(1)).alias("t_group"), F.sum("x_").alias("s_group"))


def _tested(counts: DataFrame, sizes: DataFrame, by: list[str], group: str, gene: str, pseudo: float) -> DataFrame:
    """(by, group, gene, z, logfc, pct_group, pct_rest) from counts (by, gene, v, group, t_group, s_group) and sizes (by, group, n_group), both written.

    A value's rank is the count of its gene's lower slices, a row for each slice, and of lower values of its own slice.
    """
    keys = [*by, gene]
    other = [f"{k}__" for k in keys]
    same = lambda: [F.col(k) == F.col(o) for k, o in zip(keys, other, strict=True)]
    slice_of = F.floor(F.col("v") * SLICES_PER_UNIT)
    ties = counts.groupBy(*keys, slice_of.alias("slice"), "v").agg(F.sum("t_group").alias("t"))
    lower = F.sum("n").over(Window.partitionBy(*other).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))
    slices = ties.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], F.col("slice").alias("slice_")).agg(F.sum("t").alias("n")).select(*other, "slice_", F.coalesce(lower, F.lit(0)).alias("lower"))
    within = F.sum("t").over(Window.partitionBy(*keys, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ties.withColumn("within", F.coalesce(within, F.lit(0))).join(slices, [*same(), F.col("slice") == F.col("slice_")])
    ranked = ranked.select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], F.col("v").alias("v_"), (F.col("lower") + F.col("within") + (F.col("t") + 1) / 2).alias("place"))
    placed = counts.join(ranked, [*same(), F.col("v") == F.col("v_")])
    scores = placed.groupBy(*keys, group).agg(F.sum(F.col("place") * F.col("t_group")).alias("r"), F.sum("t_group").alias("nnz_group"), F.sum("s_group").alias("s"))
    totals = sizes.groupBy(*by).agg(F.sum("n_group").alias("n_all"))
    genes = counts.groupBy(*keys, "v").agg(F.sum("t_group").alias("t"), F.sum("s_group").alias("s")).groupBy(*keys).agg(F.sum("t").alias("nnz"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"), F.sum("s").alias("s_all"))
    if by:
        grid = genes.join(totals, by).join(sizes, by)
    else:
        grid = per_group(genes.join(F.broadcast(totals)), sizes)  # one row
    grid = grid.join(scores, [*keys, group], "left").na.fill(0, ["nnz_group", "s", "r"])
    n, size, z0 = F.col("n_all").cast("double"), F.col("n_group"), (F.col("n_all") - F.col("nnz")).cast("double")
    # Cells with the gene rank above all zeros.
    r = F.col("r") + F.col("nnz_group") * z0 + (size - F.col("nnz_group")) * (z0 + 1) / 2
    spread = 1 - (F.col("ties") + z0**3 - z0) / F.nullif(n**3 - n, F.lit(0.0))
    variance = spread * size * (n - size) * (n + 1) / 12
    z = (r - size * (n + 1) / 2) / F.sqrt(F.when(variance > 1e-9, variance))
    rest = F.nullif(F.col("n_all") - size, F.lit(0))
    fold = F.log2((F.expm1(F.col("s") / size) + pseudo) / (F.expm1((F.col("s_all") - F.col("s")) / rest) + pseudo))
    return grid.select(*by, group, gene, z.alias("z"), fold.alias("logfc"), (F.col("nnz_group") / size).alias("pct_group"), ((F.col("nnz") - F.col("nnz_group")) / rest).alias("pct_rest"))


def marker_scores(expressed: DataFrame, cells: DataFrame, group: str, *, gene: str = "gene", cell: str = "cell_id", value: str = "x", digits: int = 9, pseudo: float = 1e-9) -> DataFrame:
    """(group, gene, z, logfc, pct_group, pct_rest): each group against all other cells; z has tied ranks and is null where nothing differs.

    Zeros are not stored: the n - nnz cells without a gene share the midrank (n - nnz + 1) / 2, and those with it
    rank above them.  Counts of distinct values stand for the cells; they are written once, so the expression is read once.
    """
    scratch = Scratch(expressed.sparkSession, "markers")
    counts = scratch.keep(_value_counts(expressed, cells, [], group, gene, cell, value, digits), "values")
    sizes = scratch.keep(cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_group")), "sizes")
    return _tested(counts, sizes, [], group, gene, pseudo)


def rank_sum(expressed: DataFrame, cells: DataFrame, group: str, *, gene: str = "gene", **options) -> DataFrame:
    """(group, gene, z) of marker_scores()."""
    return marker_scores(expressed, cells, group, gene=gene, **options).select(group, gene, "z")


def marker_table(expressed: DataFrame, cells: DataFrame, group: str, *, gene: str = "gene", **options) -> DataFrame:
    """marker_scores() with p and p_adj, adjusted within each group."""
    return with_p_values(marker_scores(expressed, cells, group, gene=gene, **options), group)


def significant_up(table: DataFrame, *, most: float = 0.05) -> DataFrame:
    """Rows whose adjusted p value is below most and whose fold change is above 0."""
    return table.where((F.col("p_adj") < most) & (F.col("logfc") > 0))


def adjusted(df: DataFrame, p: str, *by: str, to: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg: from the largest p down, the smallest of p * m / rank so far, 1 at most. Ties share the largest rank.

    Distinct p values are counted first and stand for the rows; null stays null.
    """
    names = [f"by{k}_" for k in range(len(by))]
    counts = df.where(F.col(p).isNotNull()).groupBy(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(p).alias("p_")).agg(F.count(F.lit(1)).alias("n_"))
    keys = names or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy("p_")
    m, last = F.sum("n_").over(Window.partitionBy(*keys)), F.sum("n_").over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = counts.withColumn("q_", F.col("p_") * m / last)
    least = least.select(*names, "p_", F.least(F.lit(1.0), F.min("q_").over(order.rowsBetween(0, Window.unboundedFollowing))).alias(to))
    on = F.col(p) == F.col("p_")
    for b, n in zip(by, names, strict=True):
        on = on & F.col(b).eqNullSafe(F.col(n))
    return df.join(least, on, "left").drop("p_", *names)


def with_p_values(scores: DataFrame, *by: str, z: str = "z") -> DataFrame:
    return adjusted(scores.withColumn("p", two_sided_normal(F.col(z))), "p", *by)


def top_markers(df: DataFrame, group: str | list[str], k: int, order: list[Column], *, only_up: str | None = None) -> DataFrame:
    """The first k of each group; only_up names a fold change that must be above 0. The limit stands on the window, so each task keeps k of a group."""
    df = df.where(F.col(only_up) > 0) if only_up else df
    by = [group] if isinstance(group, str) else group
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def pair_markers(expressed: DataFrame, cells: DataFrame, group: str, pairs: DataFrame, *, gene: str = "gene", cell: str = "cell_id", value: str = "x", digits: int = 9, pseudo: float = 1e-9, done: DataFrame | None = None) -> DataFrame:
    """(pair, group, gene, z, logfc, pct_group, pct_rest, p, p_adj) for each of the pairs (pair, a, b): a test between two groups.

    All pairs are one job; a cell takes part in every pair of its group.  Pairs that done (pair) names are left out, as their results are there.
    """
    scratch = Scratch(expressed.sparkSession, "pairs")
    if done is not None:
        pairs = pairs.join(done.select("pair").distinct(), "pair", "left_anti")
    members = scratch.keep(pairs.select("pair", F.explode(F.array("a", "b")).alias(group)), "members")
    mine = cells.join(members, group).select(cell, "pair", group)
    counts = scratch.keep(_value_counts(expressed, mine, ["pair"], group, gene, cell, value, digits), "values")
    sizes = scratch.keep(mine.groupBy("pair", group).agg(F.count(F.lit(1)).alias("n_group")), "sizes")
    return with_p_values(_tested(counts, sizes, ["pair"], group, gene, pseudo), "pair", group)


def pair_metadata(cells: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """(pair, a, b, n_a, n_b) of each pair that was asked for: how many cells stand on each side."""
    sizes = cells.groupBy(F.col(group).alias("g_")).agg(F.count(F.lit(1)).alias("n_"))
    out = pairs
    for side in "ab":
        out = out.join(sizes.withColumnRenamed("n_", f"n_{side}"), F.col(side) == F.col("g_"), "left").drop("g_")
    return out.select("pair", "a", "b", *[F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in "ab"])


def records(table: DataFrame, group: str, *, name: str = "gene", values: Sequence[str] = ("z", "logfc", "p_adj", "pct_group", "pct_rest"), k: int = 50) -> DataFrame:
    """(group, records, names): the first k rows of each group by rank as a list of structs, no number where a value is none."""
    have = [c for c in values if c in table.columns]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c)
    rows = table.where(F.col("rank") <= k).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("gene"), *[number(c) for c in have]))).alias("r_"))
    return rows.select(group, F.transform("r_", lambda x: F.struct(x["gene"].alias("gene"), *[x[c].alias(c) for c in have])).alias("records"), F.transform("r_", lambda x: x["gene"]).alias("names"))
