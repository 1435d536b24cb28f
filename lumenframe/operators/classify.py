"""Classification metrics from a confusion table, and summaries of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored_rows(df: DataFrame, true: str, *, by: list[str], training: DataFrame | None = None, unknown: str = "Unknown", fewest: int = 30) -> DataFrame:
    """Rows to be scored: true label known, trained on (if training is given), and with fewest rows or more within by."""
    df = df.where(F.col(true) != unknown)
    if training is not None:
        df = df.join(training.select(true).distinct(), true, "left_semi")
    sizes = df.groupBy(*by, true).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= fewest)
    return df.join(sizes, [*by, true], "left_semi")


def per_class(df: DataFrame, true: str, predicted: str, *, by: list[str] | None = None, predicted_only: bool = False) -> DataFrame:
    """(by, class, n_true, precision, recall, f1) of each true class, or of each class at all. Nothing divided by nothing is 0.

    One count of (true, predicted) pairs; everything after it is a few rows.
    """
    by = by or []
    pairs = df.groupBy(*by, F.col(true).alias("t_"), F.col(predicted).alias("p_")).agg(F.count(F.lit(1)).alias("n_"))
    hit = F.when(F.col("t_") == F.col("p_"), F.col("n_")).otherwise(0)
    rows = pairs.groupBy(*by, F.col("t_").alias("class")).agg(F.sum("n_").alias("n_true"), F.sum(hit).alias("tp"))
    columns = pairs.groupBy(*by, F.col("p_").alias("class")).agg(F.sum("n_").alias("n_predicted"))
    out = rows.join(columns, [*by, "class"], "full" if predicted_only else "left").na.fill(0, ["n_true", "tp", "n_predicted"])
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumns({"precision": part(F.col("tp"), F.col("n_predicted")), "recall": part(F.col("tp"), F.col("n_true")), "f1": part(2 * F.col("tp"), F.col("n_true") + F.col("n_predicted"))})
    return out.drop("tp", "n_predicted")


def summary(classes: DataFrame, *by: str) -> DataFrame:
    """(by, macro_f1, weighted_f1, n_classes, n_rows) of a table from per_class()."""
    return classes.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("weighted_f1"), F.count(F.lit(1)).alias("n_classes"), F.sum("n_true").alias("n_rows"))


def accuracy_by(df: DataFrame, correct: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"), (1 - F.avg(correct.cast("double"))).alias("error_rate"))


def true_rows_only(df: DataFrame, true: str, predicted: str, *by: str) -> DataFrame:
    """(by, class, n_true, accuracy_recall, f1_true_rows_only): scores that see a class's own rows only, so nothing predicted wrongly as it."""
    out = df.groupBy(*by, F.col(true).alias("class")).agg(F.count(F.lit(1)).alias("n_true"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy_recall"))
    return out.withColumn("f1_true_rows_only", 2 * F.col("accuracy_recall") / (1 + F.col("accuracy_recall")))


def compared(left: DataFrame, right: DataFrame, key: str, measures: list[str], names: tuple[str, str]) -> DataFrame:
    """Both tables side by side by key, whichever has it, and what the second has more."""
    a = left.select(key, *[F.col(m).alias(f"{m}_{names[0]}") for m in measures])
    b = right.select(key, *[F.col(m).alias(f"{m}_{names[1]}") for m in measures])
    return a.join(b, key, "full").select("*", *[(F.col(f"{m}_{names[1]}") - F.col(f"{m}_{names[0]}")).alias(f"{m}_delta") for m in measures])


def majority_baseline(df: DataFrame, label: str, batch: str) -> DataFrame:
    """One row: how often the most frequent batch of a row's label is its batch."""
    counts = df.groupBy(label, batch).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(label).agg(F.max("n").alias("most"), F.sum("n").alias("all")).agg((F.sum("most") / F.sum("all")).alias("baseline"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information (by the mean of the entropies) and adjusted Rand index."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = lambda *c: Window.partitionBy(*c) if c else Window.partitionBy(F.lit(1))
    cells = cells.withColumns({"na": F.sum("n").over(w(a)), "nb": F.sum("n").over(w(b)), "all": F.sum("n").over(w()), "ka": F.count("n").over(w(a)), "kb": F.count("n").over(w(b))})
    two = lambda x: x * (x - 1) / 2
    out = cells.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"), (-F.sum(F.col("n") / F.col("all") * F.ln(F.col("na") / F.col("all")))).alias("ha"), (-F.sum(F.col("n") / F.col("all") * F.ln(F.col("nb") / F.col("all")))).alias("hb"), F.sum(two(F.col("n"))).alias("same"), F.sum(two(F.col("na")) / F.col("ka")).alias("pa"), F.sum(two(F.col("nb")) / F.col("kb")).alias("pb"), F.max(two(F.col("all"))).alias("pairs"))
    expected = F.col("pa") * F.col("pb") / F.col("pairs")
    return out.select((2 * F.col("mi") / F.nullif(F.col("ha") + F.col("hb"), F.lit(0.0))).alias("nmi"), ((F.col("same") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))).alias("ari"))
