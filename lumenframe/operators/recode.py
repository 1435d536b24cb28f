"""Recoding of categories: missing assays, composite keys, mapped and draft labels, review notes and priorities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary


def clean_assay(assay: Column, fill: str) -> Column:
    """Missing, or the text nan, becomes fill; the text None stays."""
    return F.coalesce(F.nullif(assay.cast("string"), F.lit("nan")), F.lit(fill))


def composite(*parts: Column) -> Column:
    return F.concat_ws(" || ", *parts)


def map_strict(df: DataFrame, column: str, mapping: Mapping[str, str], to: str, *, named: int = 10_000) -> DataFrame:
    """Mapped labels; ValueError lists the values that the mapping lacks, numbers in their order; of more than named, any of them and a note."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    missing = [r[0] for r in df.where(~F.col(column).cast("string").isin(*mapping)).select(F.col(column).cast("string")).distinct().limit(named + 1).collect()]
    if missing:
        shown = sorted(missing[:named], key=lambda x: (not x.isdigit(), int(x) if x.isdigit() else 0, x))
        raise ValueError("no label for: " + ", ".join(shown) + (", and others" if len(missing) > named else ""))
    return df.withColumn(to, table[F.col(column).cast("string")])


def map_default(c: Column, mapping: Mapping[str, str], suffix: str = " review") -> Column:
    """Mapped, or the value itself with a suffix."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.concat(c, F.lit(suffix)))


def draft_label(top_label: Column, top_tissue: Column, top_assay: Column, mapping: Mapping[str, str] = vocabulary.DRAFT_OF_LABEL) -> Column:
    base = map_default(top_label, mapping)
    return (
        F.when(base == "Cytokine-Stimulated review", F.lit("Cytokine-Stimulated review: split effector vs CCR7+ after markers"))
        .when((base == "Transitional Cytotoxic") & top_tissue.isin("decidua", "lung"), F.lit("Transitional Cytotoxic Tissue-Resident review"))
        .when((base == "Mature Cytotoxic") & (top_assay == "Flex Gene Expression"), F.lit("Mature Cytotoxic Engineered review"))
        .otherwise(base)
    )


def review_notes(tissue: Column, assay: Column, dataset: Column, label: Column, *, specific: float = 0.85, dataset_specific: float = 0.75, mixed: float = 0.70) -> Column:
    """Flags of the largest shares, joined by semicolons; null shares raise none."""
    return F.concat_ws(
        ";",
        F.when(tissue >= specific, F.lit("high_tissue_specificity")),
        F.when(assay >= specific, F.lit("high_assay_specificity")),
        F.when(dataset >= dataset_specific, F.lit("high_dataset_specificity")),
        F.when(label < mixed, F.lit("mixed_original_NK_State")),
    )


def review_priority(n: Column, label: Column, notes: Column, share: Column, *, few: int = 300, mixed: float = 0.70) -> Column:
    return (
        F.when((n < few) | label.contains("review") | notes.contains("high_dataset_specificity"), F.lit("high"))
        .when((share < mixed) | notes.contains("high_tissue_specificity") | notes.contains("high_assay_specificity"), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def masked_label(df: DataFrame, label: str, is_query: Column, unknown: str = "Unknown") -> DataFrame:
    """The label of query rows becomes unknown; the truth stays beside it."""
    return df.withColumns({f"{label}_true": F.col(label), label: F.when(is_query, F.lit(unknown)).otherwise(F.col(label))})


def class_summary(df: DataFrame, label: str, *, mode: str = "sqrt_inv_freq", low: float = 0.1, high: float = 10.0, epsilon: float = 1e-8) -> DataFrame:
    """(label, n_cells, percent, weight): inverse frequency weights, clipped, then divided by their mean."""
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"))
    every = Window.partitionBy(F.lit(1))
    out = out.withColumn("percent", 100.0 * F.col("n_cells") / F.sum("n_cells").over(every))
    raw = {"inv_percent": 1.0 / (F.col("percent") + epsilon), "inv_freq": 1.0 / (F.col("n_cells") + epsilon), "sqrt_inv_freq": 1.0 / F.sqrt(F.col("n_cells") + epsilon)}
    if mode not in raw:
        raise ValueError(f"weights {mode!r}: one of {', '.join(raw)}")
    clipped = F.least(F.greatest(raw[mode], F.lit(low)), F.lit(high))
    return out.withColumn("weight", clipped).withColumn("weight", F.col("weight") / (F.avg("weight").over(every) + epsilon))


def class_weight_vector(labels: DataFrame, summary: DataFrame, label: str, *, unknown: str = "Unknown", low: float = 0.25, high: float = 1.0) -> DataFrame:
    """(label, weight) of each label: unknown 0, labels without a summary 1, all but unknown clipped again."""
    joined = labels.select(label).distinct().join(summary.select(label, "weight"), label, "left")
    weight = F.least(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(low)), F.lit(high))
    return joined.select(label, F.when(F.col(label) == unknown, F.lit(0.0)).otherwise(weight).alias("weight"))


def sorted_codes(df: DataFrame, column: str, to: str) -> DataFrame:
    """Numbers from 0 of a column's values in their order. The order is taken over distinct values only."""
    codes = df.select(column).distinct().withColumn(to, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column)
