"""Evidence about groups: marker programs, related groups, assembled records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary


def program_hits(genes: DataFrame, group: str, gene: str, programs: Mapping[str, Sequence[str]] = vocabulary.PROGRAMS) -> DataFrame:
    """(group, program, genes): the genes of each program that a group has, whatever their case, in the program's order; no row without any."""
    spark = genes.sparkSession
    table = spark.createDataFrame([(p, k, g) for p, gs in programs.items() for k, g in enumerate(gs)], "program string, place int, program_gene string")
    table = table.withColumn("key_", F.upper("program_gene"))
    have = genes.select(group, F.upper(gene).alias("key_")).distinct()
    hits = have.join(F.broadcast(table), "key_")
    return hits.groupBy(group, "program").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "program_gene"))), lambda x: x["program_gene"]).alias("genes"))


def related_groups(groups: DataFrame, *, key: str = "cluster", label: str = "label", draft: str = "draft", genes: str = "genes", first: int = 25, fewest: int = 3, most: int = 6) -> DataFrame:
    """(key, other, score, rank): up to most groups of the same label or draft, or with fewest genes in common.

    Null equals null.  Score is one for each of label and draft and a tenth for each gene; of
    equals the key that is last as text comes first.
    """
    a = groups.select(F.col(key).alias("a_"), F.col(label).alias("la"), F.col(draft).alias("da"), F.transform(F.slice(genes, 1, first), lambda g: F.upper(g)).alias("ga"))
    b = a.toDF("b_", "lb", "db", "gb")
    pairs = a.join(F.broadcast(b), F.col("a_") != F.col("b_"))  # a few groups
    common = F.size(F.array_intersect("ga", "gb"))
    same_label, same_draft = F.col("la").eqNullSafe(F.col("lb")), F.col("da").eqNullSafe(F.col("db"))
    pairs = pairs.where(same_label | same_draft | (common >= fewest)).withColumn("score", same_label.cast("int") + same_draft.cast("int") + common / 10)
    rank = F.row_number().over(Window.partitionBy("a_").orderBy(F.desc("score"), F.desc("b_")))
    return pairs.select(F.col("a_").alias(key), F.col("b_").alias("other"), "score", rank.alias("rank")).where(F.col("rank") <= most)


def top_numbers(df: DataFrame, group: str, name: str, value: str, n: int = 30) -> DataFrame:
    """(group, values): map of the n largest values of each group."""
    top = df.where(F.col(value).isNotNull()).withColumn("r_", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), name))).where(F.col("r_") <= n)
    return top.groupBy(group).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r_", name, value))), lambda x: F.struct(x[name], x[value]))).alias("values"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base with over's columns; where both have one, over's value stands unless it is null."""
    renamed = over.select(key, *[F.col(c).alias(f"{c}_o_") for c in over.columns if c != key])
    out = base.join(renamed, key, "left")
    for c in over.columns:
        if c != key:
            new = F.coalesce(f"{c}_o_", c) if c in base.columns else F.col(f"{c}_o_")
            out = out.withColumn(c, new).drop(f"{c}_o_")
    return out


def assembled(key: str, main: DataFrame, *others: DataFrame) -> DataFrame:
    """One row for each group of main with the columns of all others, left-joined by key."""
    for other in others:
        main = main.join(other, key, "left")
    return main


def ordered_union(df: DataFrame, value: str, order: Column) -> DataFrame:
    """(value, place) of each distinct value, in the order it is first met."""
    return df.groupBy(value).agg(F.min(order).alias("place"))


def high_other_lineage(means: Column, programs: Sequence[str] = ("T cell", "B cell", "myeloid", "erythroid"), threshold: float = 1.0) -> Column:
    """Whether any gene of the programs reaches threshold in a map of means."""
    genes = [g for p in programs for g in vocabulary.PROGRAMS[p]]
    return F.exists(F.lit(genes), lambda g: F.coalesce(F.try_element_at(means, g), F.lit(0.0)) >= threshold)
