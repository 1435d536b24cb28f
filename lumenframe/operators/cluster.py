"""Models that stand in for deep ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(points: DataFrame, k: int, *, key: str = "id", vector: str = "z") -> DataFrame:
    """(key, components): a linear stand-in for a learned latent space, or with k = 2 for its map."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(data).transform(data).select(key, vector_to_array("p").alias("components"))


def logistic_labels(train: DataFrame, rows: DataFrame, *, label: str, vector: str, key: str = "id", weight: str | None = None) -> DataFrame:
    """(key, pred_label, probabilities): a weighted logistic classifier, the stand-in for a semi-supervised deep one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = array_to_vector(F.col(vector).cast("array<double>")).alias("v")
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    data = index.transform(train.select(label, vec, *([weight] if weight else [])))
    model = LogisticRegression(featuresCol="v", labelCol="y", maxIter=30, regParam=0.01, **({"weightCol": weight} if weight else {})).fit(data)
    out = model.transform(rows.select(key, vec))
    names = F.lit(list(index.labels))
    return out.select(key, F.get(names, F.col("prediction").cast("int")).alias("pred_label"), vector_to_array("probability").alias("probabilities"))
