"""Logical tables over the driver's: cells are orders, genes are part names, latent vectors are embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import distance

#: SQL of the same tables.
OBS = """obs AS (
  SELECT o_orderkey AS cell_id, 'd' || c_nationkey AS dataset_id,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'nan' ELSE o_orderpriority END AS assay,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'lung' ELSE c_mktsegment END AS tissue,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Mature Cytotoxic' WHEN o_orderstatus = 'O' THEN 'Transitional Cytotoxic' ELSE o_orderstatus END AS label,
         CAST(o_orderkey % 25 AS VARCHAR) AS cluster, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CLEAN = OBS + """, clean AS (
  SELECT *, coalesce(nullif(assay, 'nan'), 'Flex Gene Expression') AS assay_clean FROM obs)"""
COUNTS = """counts AS (
  SELECT l_orderkey AS cell_id, p_name AS gene, sum(l_quantity) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
EXPRESSED = COUNTS + """, expressed AS (
  SELECT *, ln(1 + count / (sum(count) OVER (PARTITION BY cell_id)) * 10000) AS x FROM counts)"""
CENTRES = """centre_dims AS (
  SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2
), centres AS (SELECT label, list(m ORDER BY k) AS centre FROM centre_dims GROUP BY 1)"""
PROBA = CENTRES + """, proba AS (
  SELECT vec_id, e.label AS label, c.label AS class, exp(-list_distance(embedding::DOUBLE[], centre)) AS w FROM embeddings e, centres c
), probabilities AS (SELECT vec_id, label, class, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM proba)"""
PREDICTED = PROBA + """, predicted AS (
  SELECT vec_id, 'L' || label AS label, 'L' || arg_max(class, p - class * 1e-15) AS pred, max(p) AS confidence, 'b' || (vec_id % 3) AS batch, 'd' || (vec_id % 5) AS dataset
  FROM (SELECT vec_id, label, class, round(p, 12) AS p FROM probabilities) GROUP BY vec_id, label)"""


def obs(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("o_orderkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    return joined.select(
        k.alias("cell_id"),
        F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dataset_id"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, F.lit("nan")).otherwise(F.col("o_orderpriority")).alias("assay"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("lung")).otherwise(F.col("c_mktsegment")).alias("tissue"),
        F.when(k % 13 == 0, F.lit("Unknown")).when(status == "F", F.lit("Mature Cytotoxic")).when(status == "O", F.lit("Transitional Cytotoxic")).otherwise(status).alias("label"),
        (k % 25).cast("string").alias("cluster"),
        F.col("c_nationkey").alias("nation"),
    )


def counts(spark: SparkSession, d: str) -> DataFrame:
    lines, part = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_name").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def latent(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return latent(spark, d).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"), "label", F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("batch"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, class, p): closeness to the centre of each label. Centres are as few as labels."""
    from ..operators.distance import centroids

    e = latent(spark, d)
    centres = centroids(e, "label", "embedding").select(F.col("cluster").cast("int").alias("class"), "centre")
    w = e.join(F.broadcast(centres)).select("vec_id", "label", "class", F.exp(-distance(F.col("embedding"), F.col("centre"))).alias("w"))
    return w.select("vec_id", "label", "class", (F.col("w") / F.sum("w").over(Window.partitionBy("vec_id"))).alias("p"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, pred, confidence, batch, dataset): argmax, of equals the first class."""
    p = probabilities(spark, d).withColumn("p", F.round("p", 12))
    best = p.groupBy("vec_id", "label").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("pred"), F.max("p").alias("confidence"))
    name = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    return best.select("vec_id", name("L", F.col("label")).alias("label"), name("L", F.col("pred")).alias("pred"), "confidence", name("b", F.col("vec_id") % 3).alias("batch"), name("d", F.col("vec_id") % 5).alias("dataset"))
