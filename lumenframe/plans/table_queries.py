"""Queries: unions, key sets, medians, rollups, evidence tables, selections and text summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attribution, classify, compose, distance, evidence, markers, vocabulary
from ..schema import in_order
from .composition import SPLIT, split
from .evaluation_queries import BD, GUESSED, R9, SUMMARY, _classes, _kept, guessed, rounded
from .expression_queries import ATTR, ZSQL, attributed, z_scores
from .registry import query
from .review_queries import HELD, PROGRAM_ROWS, held
from .standins import CENTRES, OBS, PREDICTED, latent, obs, predicted


@query(f"WITH {SPLIT} SELECT split AS _split, label, count(*) AS n FROM split GROUP BY 1, 2")
def split_concat(spark, d):
    """Parts tagged with their split, put together again."""
    s = split(spark, d)
    parts = [s.where(F.col("split") == name).drop("split").withColumn("_split", F.lit(name)) for name in ("Train", "Val", "Held-out")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True).groupBy("_split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, round(median(embedding[1]::DOUBLE), 9) AS x, round(median(embedding[2]::DOUBLE), 9) AS y, count(*) AS n FROM embeddings GROUP BY 1")
def category_centres(spark, d):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return latent(spark, d).groupBy("label").agg(F.round(F.median(at(0)), 9).alias("x"), F.round(F.median(at(1)), 9).alias("y"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CENTRES} SELECT label::VARCHAR AS cluster, k::INT - 1 AS dimension, round(m, 9) AS mean FROM centre_dims")
def centroid_vectors(spark, d):
    c = distance.centroids(latent(spark, d), "label", "embedding")
    return c.select("cluster", F.posexplode("centre").alias("dimension", "mean")).withColumn("mean", F.round("mean", 9))


@query(f"WITH {OBS}, c AS (SELECT tissue, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tissue) AS rank FROM c) SELECT CASE WHEN rank <= 3 THEN tissue ELSE 'other' END AS tissue, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def most_common(spark, d):
    c = obs(spark, d).groupBy("tissue").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tissue")))
    return c.groupBy(F.when(F.col("rank") <= 3, F.col("tissue")).otherwise(F.lit("other")).alias("tissue")).agg(F.sum("n").alias("n"))


@query(f"""WITH {GUESSED}, {_kept(BD, 8)}, {_classes(BD)}, s AS ({SUMMARY.format(by=BD)} GROUP BY 1), a AS (SELECT dataset, count(*) AS n_cells, count(DISTINCT label) AS n_labels, count(DISTINCT batch) AS n_batches, sum((label = pred)::INT)::BIGINT AS n_correct, round(avg((label = pred)::INT), 9) AS accuracy, round(1 - avg((label = pred)::INT), 9) AS error_rate, round(median(confidence), 9) AS median_confidence FROM guessed WHERE label <> 'Unknown' GROUP BY 1)
SELECT a.*, {R9} FROM a JOIN s USING (dataset)""")
def by_dataset_rollup(spark, d):
    g = guessed(spark, d).where("label <> 'Unknown'")
    right = (F.col("label") == F.col("pred")).cast("int")
    a = g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("label").alias("n_labels"), F.count_distinct("batch").alias("n_batches"), F.sum(right).alias("n_correct"), F.avg(right).alias("accuracy"), (1 - F.avg(right)).alias("error_rate"), F.median("confidence").alias("median_confidence"))
    rows = classify.scored_rows(guessed(spark, d), "label", by=["dataset"], fewest=8)
    out = a.join(classify.summary(classify.per_class(rows, "label", "pred", by=["dataset"]), "dataset"), "dataset")
    return rounded(out, "accuracy", "error_rate", "median_confidence", "macro_f1", "weighted_f1")


@query(f"WITH {PREDICTED}, c AS (SELECT label, confidence, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, vec_id) AS r FROM predicted WHERE label = pred AND confidence >= 0.105) SELECT label, count(*) AS n, round(max(confidence), 9) AS best FROM c WHERE r <= 5 GROUP BY 1")
def selected_cells(spark, d):
    p = predicted(spark, d)
    right = p.where((F.col("label") == F.col("pred")) & (F.col("confidence") >= 0.105))
    top = markers.top_markers(right, "label", 5, [F.desc("confidence"), F.col("vec_id")])
    return top.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 9).alias("best"))


@query(f"WITH {PREDICTED} SELECT vec_id, confidence >= 0.105 AS sure FROM (SELECT vec_id, round(confidence, 9) AS confidence FROM predicted WHERE label = 'L3' AND pred = 'L3') WHERE confidence >= 0.1")
def state_selection(spark, d):
    p = predicted(spark, d).withColumn("confidence", F.round("confidence", 9))
    s = attribution.selected_cells(p, "L3", predicted="pred", least=0.1)
    return s.select("vec_id", (F.col("confidence") >= 0.105).alias("sure"))


@query(f"{ZSQL}, ups AS (SELECT grp, gene, round(z, 5) AS z FROM z WHERE z > 1), placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, gene) AS k FROM ups) SELECT gene, min(grp) AS first_label FROM placed WHERE k <= 3 GROUP BY 1")
def marker_selection(spark, d):
    """Genes for a plot: the first three of each group that are clearly up, each once, with the group that has it first."""
    z = z_scores(spark, d).where("z > 1").withColumn("z", F.round("z", 5))
    top = markers.top_markers(z, "label", 3, [F.desc("z"), F.col("gene")])
    return evidence.ordered_union(top, "gene", F.col("label")).withColumnRenamed("place", "first_label")


@query(f"WITH {HELD}, {PROGRAM_ROWS} SELECT program AS marker_set, gene FROM programs WHERE gene IN (SELECT upper(gene) FROM held)")
def curated_listing(spark, d):
    sets = spark.createDataFrame([(p, g) for p, gs in vocabulary.PROGRAMS.items() for g in gs], "marker_set string, gene string")
    return sets.join(held(spark, d).select(F.upper("gene").alias("gene")).distinct(), "gene", "left_semi").select("marker_set", "gene")


@query(f"""WITH {HELD}, v AS (SELECT cluster, upper(gene) AS gene, max(place)::DOUBLE / 4 AS v FROM held GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, gene) AS k FROM v)
SELECT cluster, string_agg(gene, ', ' ORDER BY k) AS genes, count(*) AS n FROM r WHERE k <= 8 AND v > 0 GROUP BY 1""")
def marker_value_summary(spark, d):
    v = held(spark, d).groupBy("cluster", F.upper("gene").alias("gene")).agg((F.max("place").cast("double") / 4).alias("v"))
    top = markers.top_markers(v, "cluster", 8, [F.desc("v"), F.col("gene")]).where("v > 0")
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda x: x["gene"]), ", ").alias("genes"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HELD}, v AS (SELECT cluster, gene, max(place)::DOUBLE AS v FROM held GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, gene) AS k FROM v)
SELECT cluster, count(*) AS n, max(v) AS top, min(v) AS last FROM r WHERE k <= 5 GROUP BY 1""")
def curated_mean_maps(spark, d):
    v = held(spark, d).groupBy("cluster", "gene").agg(F.max("place").cast("double").alias("v"))
    maps = evidence.top_numbers(v, "cluster", "gene", "v", 5)
    values = F.map_values("values")
    return maps.select("cluster", F.size("values").cast("long").alias("n"), F.array_max(values).alias("top"), F.array_min(values).alias("last"))


@query(f"""WITH {OBS}, a AS (SELECT cluster, label, count(*) AS n FROM obs GROUP BY 1, 2), t AS (SELECT cluster, sum(n) AS t FROM a GROUP BY 1), r AS (SELECT cluster, label, n, n / t AS f, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM a JOIN t USING (cluster))
SELECT cluster, string_agg(label || ' (' || n || ')', '; ' ORDER BY k) AS composition FROM r WHERE k <= 8 GROUP BY 1""")
def composition_text(spark, d):
    lists = compose.composition_lists(obs(spark, d), "cluster", "label")
    shown = F.transform("composition", lambda x: F.concat(x["label"], F.lit(" ("), x["n_cells"].cast("string"), F.lit(")")))
    return lists.select("cluster", F.array_join(shown, "; ").alias("composition"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
u AS (SELECT k, 'both' AS kind FROM a INTERSECT SELECT k, 'both' FROM b), l AS (SELECT k FROM a EXCEPT SELECT k FROM b), e AS (SELECT k FROM a UNION SELECT k FROM b) SELECT 'both' AS kind, count(*) AS n FROM u UNION ALL SELECT 'first only', count(*) FROM l UNION ALL SELECT 'either', count(*) FROM e""")
def key_sets(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    a, b = (o.where(F.col(c) == v).select(F.col("o_custkey").alias("k")).distinct() for c, v in (("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first only")).unionByName(count(a.union(b).distinct(), "either"))


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT least(a.cluster::INT, b.cluster::INT) AS a, greatest(a.cluster::INT, b.cluster::INT) AS b FROM (SELECT DISTINCT cluster FROM obs) a, (SELECT DISTINCT cluster FROM obs) b WHERE a.cluster <> b.cluster)
SELECT 'leiden_0_4_' || a || '_vs_' || b AS pair FROM p""")
def pair_names(spark, d):
    a = obs(spark, d).select(F.col("cluster").cast("int").alias("a")).distinct()
    pairs = a.join(F.broadcast(a.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # a few groups
    return pairs.select(F.concat(F.lit("leiden_0_4_"), F.col("a").cast("string"), F.lit("_vs_"), F.col("b").cast("string")).alias("pair"))


@query(f"""WITH {OBS}, s AS (SELECT cluster, count(*) AS n_cells, min(label) AS first_label FROM obs GROUP BY 1), w AS (SELECT cluster, CASE WHEN cluster::INT % 3 = 0 THEN NULL ELSE 'sheet ' || cluster END AS first_label, cluster::DOUBLE AS extra FROM s WHERE cluster::INT % 2 = 0)
SELECT s.cluster, n_cells, coalesce(w.first_label, s.first_label) AS first_label, extra FROM s LEFT JOIN w USING (cluster)""")
def evidence_overlay(spark, d):
    s = obs(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.min("label").alias("first_label"))
    n = F.col("cluster").cast("int")
    w = s.where(n % 2 == 0).select("cluster", F.when(n % 3 == 0, None).otherwise(F.concat(F.lit("sheet "), F.col("cluster"))).alias("first_label"), n.cast("double").alias("extra"))
    return evidence.overlay(s, w, "cluster")


@query(f"{ATTR}, s AS (SELECT state, count(*) AS n FROM ranked GROUP BY 1) SELECT state, row_number() OVER (ORDER BY CASE state WHEN 'P' THEN 0 WHEN 'Mature Cytotoxic' THEN 1 ELSE 9 END, state) AS place FROM s")
def preferred_states(spark, d):
    s = attributed(spark, d).select("state").distinct()
    order = Window.orderBy(F.coalesce(in_order(["P", "Mature Cytotoxic"], F.col("state")), F.lit(9)), "state")
    return s.select("state", F.row_number().over(order).alias("place"))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b, max(p_size)::DOUBLE AS c FROM part GROUP BY 1), s AS (SELECT p_brand, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, 1 - (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b FROM m)
SELECT p_brand, round((a + b) / 2, 6) AS overall, row_number() OVER (ORDER BY round((a + b) / 2, 6) DESC, p_brand) AS place FROM s""")
def strategy_scores(spark, d):
    from ..functions.numbers import min_max_scaled

    m = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    s = m.select("p_brand", F.round((min_max_scaled(F.col("a")) + min_max_scaled(F.col("b"), lower_is_better=True)) / 2, 6).alias("overall"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("overall"), "p_brand")))
