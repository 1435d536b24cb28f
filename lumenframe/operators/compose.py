"""Composition of groups: counts, crosstabs, largest categories and their shares, batch profiles, worksheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import recode


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by columns, zeros filled in; values are the columns, in their order."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def top_category(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, top_<category>, top_<category>_frac): the most frequent one, of equals the smallest; null counts as the text nan."""
    counts = df.groupBy(group, F.coalesce(F.col(category).cast("string"), F.lit("nan")).alias("c_")).agg(F.count(F.lit(1)).alias("n_"))
    return counts.groupBy(group).agg(F.max(F.struct("n_", "c_")).alias("most_"), F.sum("n_").alias("total_"), F.min_by("c_", F.struct(-F.col("n_"), F.col("c_"))).alias("top_")).select(group, F.col("top_").alias(f"top_{category}"), (F.col("most_.n_") / F.col("total_")).alias(f"top_{category}_frac"))


def cluster_summary(df: DataFrame, group: str, categories: Sequence[str]) -> DataFrame:
    """Size of each group and the largest share in each category.

    All categories are counted in one pass: a row is spread over (category, value) pairs, and counts are combined
    before the shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in categories])).alias("p")
    counts = df.select(group, pairs).groupBy(group, "p.name", "p.value").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy(group, "name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total"))
    pick = lambda c, what: F.max(F.when(F.col("name") == c, what))
    out = [x for c in categories for x in (pick(c, F.col("top")).alias(f"top_{c}"), pick(c, F.col("most") / F.col("total")).alias(f"top_{c}_frac"))]
    return tops.groupBy(group).agg(F.max("total").alias("n_cells"), *out)


def worksheet(df: DataFrame, group: str, *, label: str, tissue: str, assay: str, dataset: str) -> DataFrame:
    """The annotation worksheet: composition, draft label, review notes and priority of each group."""
    out = cluster_summary(df, group, [label, tissue, dataset, assay])
    out = out.withColumn("draft_refined_label", recode.draft_label(F.col(f"top_{label}"), F.col(f"top_{tissue}"), F.col(f"top_{assay}")))
    out = out.withColumn("review_notes", recode.review_notes(F.col(f"top_{tissue}_frac"), F.col(f"top_{assay}_frac"), F.col(f"top_{dataset}_frac"), F.col(f"top_{label}_frac")))
    return out.withColumn("review_priority", recode.review_priority(F.col("n_cells"), F.col("draft_refined_label"), F.col("review_notes"), F.col(f"top_{label}_frac")))


def top_composition(df: DataFrame, group: str, category: str, n: int = 8) -> DataFrame:
    """(group, rank, category, n_cells, fraction) of the n largest categories of each group."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n_cells"))
    counts = counts.withColumn("fraction", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(group)))
    order = Window.partitionBy(group).orderBy(F.desc("n_cells"), category)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def composition_lists(df: DataFrame, group: str, category: str, n: int = 8) -> DataFrame:
    """The same as one ordered list of structs for each group."""
    top = top_composition(df, group, category, n)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(category).alias("label"), "n_cells", "fraction"))), lambda x: F.struct(x["label"].alias("label"), x["n_cells"].alias("n_cells"), x["fraction"].alias("fraction"))).alias("composition"))


def merge_rare_assays(df: DataFrame, dataset: str, assay: str, to: str, fewest: int = 100) -> DataFrame:
    """Assays with fewer cells than fewest become their dataset's most frequent one (of equals the smallest)."""
    counts = df.groupBy(dataset, assay).agg(F.count(F.lit(1)).alias("n_"))
    main = Window.partitionBy(dataset).orderBy(F.desc("n_"), assay)
    merged = counts.select(F.col(dataset).alias("d_"), F.col(assay).alias("a_"), F.when(F.col("n_") < fewest, F.first(assay).over(main)).otherwise(F.col(assay)).alias(to))
    return df.join(merged, (F.col(dataset) == F.col("d_")) & (F.col(assay) == F.col("a_"))).drop("d_", "a_")


def batch_profile(df: DataFrame, dataset: str, assay: str, *, warn: int = 500, hard: int = 100) -> DataFrame:
    """One row: how many datasets, assays and combinations, the worst case, and combinations by size."""
    combos = df.groupBy(dataset, assay).agg(F.count(F.lit(1)).alias("n"))
    out = combos.agg(F.count_distinct(dataset).alias("n_datasets"), F.count_distinct(assay).alias("n_assays"), F.count(F.lit(1)).alias("n_combos"), F.count_if(F.col("n") < warn).alias("n_below_warn"), F.count_if(F.col("n") < hard).alias("n_below_hard"), F.count_if(F.col("n") >= warn).alias("n_stable"))
    return out.withColumn("worst_case", F.col("n_datasets") * F.col("n_assays"))


def log10_pivot(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Log10 of the counts; null where there is none."""
    table = crosstab(df, rows, columns, values)
    return table.select(rows, *[F.log10(F.nullif(F.col(f"`{v}`"), F.lit(0))).alias(v) for v in values])


def size_range(df: DataFrame, resolutions: Sequence[str]) -> DataFrame:
    """(resolution, n_clusters, min_cluster_size, max_cluster_size), all in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("resolution"), F.col(r).cast("string").alias("cluster")) for r in resolutions])).alias("p")
    sizes = df.select(pairs).groupBy("p.resolution", "p.cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("resolution").agg(F.count(F.lit(1)).alias("n_clusters"), F.min("n").alias("min_cluster_size"), F.max("n").alias("max_cluster_size"))


def histogram(c: Column, edges: Sequence[float]) -> Column:
    """The number, from 1, of the bin [edge, next edge) that a value is in; the last bin has its end too; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        inside = (c >= edges[k - 1]) & ((c <= edges[k]) if k == len(edges) - 1 else (c < edges[k]))
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


def hexagons(df: DataFrame, x: str, y: str, value: str, *, size: int, fewest: int = 1) -> DataFrame:
    """(hx, hy, n, mean): mean of a value by hexagon; size hexagons span the range of x.

    Centres are two rectangular grids, one shifted by half a cell; a point belongs to the nearer centre, with
    distances in y weighed by 3, and to the first grid where both are as near.
    """
    rows = max(1, int(size / 3**0.5))
    bounds = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = df.select(F.col(x).alias("x_"), F.col(y).alias("y_"), F.col(value).alias("value_")).join(F.broadcast(bounds))  # one row
    unit = lambda c, a, b, n: F.coalesce((F.col(c) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)) * n, F.lit(0.0))
    at = at.select("value_", unit("x_", "x0", "x1", size).alias("u"), unit("y_", "y0", "y1", rows).alias("w"))
    at = at.withColumns({"u1": F.floor(F.col("u") + 0.5), "w1": F.floor(F.col("w") + 0.5), "u2": F.floor("u"), "w2": F.floor("w")})
    far = lambda a, b, s: (F.col("u") - F.col(a) - s) * (F.col("u") - F.col(a) - s) + 3 * (F.col("w") - F.col(b) - s) * (F.col("w") - F.col(b) - s)
    first = far("u1", "w1", 0.0) <= far("u2", "w2", 0.5)
    at = at.withColumns({"hx": F.when(first, F.col("u1") * 1.0).otherwise(F.col("u2") + 0.5), "hy": F.when(first, F.col("w1") * 1.0).otherwise(F.col("w2") + 0.5)})
    return at.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n"), F.avg("value_").alias("mean")).where(F.col("n") >= fewest)
