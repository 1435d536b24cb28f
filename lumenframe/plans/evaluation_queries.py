"""Queries: probabilities, classification metrics, distances, neighbours, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import classify, cluster, distance, neighbors, recode, sampling
from .registry import query
from .standins import CENTRES, PREDICTED, PROBA, latent, points, predicted, probabilities

def guessed(spark, d):
    """Predictions that are right more often than the stand-in's own: a third of the rows keep their true label."""
    p = predicted(spark, d)
    return p.withColumn("pred", F.when(F.col("vec_id") % 3 != 0, F.col("label")).otherwise(F.col("pred"))).withColumn("label", F.when(F.col("vec_id") % 41 == 0, F.lit("Unknown")).otherwise(F.col("label")))


GUESSED = PREDICTED + """, guessed AS (SELECT vec_id, CASE WHEN vec_id % 41 = 0 THEN 'Unknown' ELSE label END AS label, CASE WHEN vec_id % 3 <> 0 THEN label ELSE pred END AS pred, confidence, batch, dataset FROM predicted)"""


@query(f"""WITH {PROBA}, r AS (SELECT vec_id, class, round(p, 12) AS p FROM probabilities), a AS (SELECT vec_id, list(p ORDER BY class) AS p FROM r GROUP BY 1)
SELECT vec_id, 'L' || (list_position(p, list_max(p)) - 1) AS pred_label, round(list_max(p) + 1e-12, 9) AS confidence, round(1 + list_sum(list_transform(p, lambda x: (x + 1e-12) * ln(x + 1e-12))) / ln(len(p)), 9) AS certainty FROM a""")
def argmax_confidence_entropy(spark, d):
    p = probabilities(spark, d).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", F.round("p", 12).alias("p")))), lambda x: x["p"]).alias("p"))
    names = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.concat(F.lit("L"), k.cast("string")))
    return p.select("vec_id", numbers.first_of_largest(F.col("p"), names).alias("pred_label"), F.round(numbers.confidence(F.col("p")), 9).alias("confidence"), F.round(numbers.certainty(F.col("p")), 9).alias("certainty"))


def _kept(by="", fewest=30):
    return f"kept AS (SELECT * FROM guessed WHERE label <> 'Unknown' AND ({by}label) IN (SELECT ({by}label) FROM guessed WHERE label <> 'Unknown' GROUP BY {by}label HAVING count(*) >= {fewest}))"


def _classes(by="", src="kept"):
    return f"t AS (SELECT {by}label AS class, count(*) AS n_true, count(*) FILTER (label = pred) AS tp FROM {src} GROUP BY {by}label), q AS (SELECT {by}pred AS class, count(*) AS n_pred FROM {src} GROUP BY {by}pred), k AS (SELECT {by}class, n_true, coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0) AS precision, tp / n_true::DOUBLE AS recall, 2.0::DOUBLE * tp / (n_true + coalesce(n_pred, 0)) AS f1 FROM t LEFT JOIN q USING ({by}class))"


R9 = "round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1, n_classes, n_rows"
SUMMARY = "SELECT {by}avg(f1) AS macro_f1, sum(f1 * n_true) / sum(n_true) AS weighted_f1, count(*) AS n_classes, sum(n_true)::BIGINT AS n_rows FROM k"


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {GUESSED}, {_kept()}, {_classes()}, s AS ({SUMMARY.format(by='')}) SELECT {R9} FROM s")
def macro_weighted_f1(spark, d):
    rows = classify.scored_rows(guessed(spark, d), "label", by=[])
    return rounded(classify.summary(classify.per_class(rows, "label", "pred")), "macro_f1", "weighted_f1")


@query(f"WITH {GUESSED}, {_kept()}, {_classes()} SELECT class, n_true, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM k")
def per_class_metrics(spark, d):
    rows = classify.scored_rows(guessed(spark, d), "label", by=[])
    return rounded(classify.per_class(rows, "label", "pred"), "precision", "recall", "f1")


BD = "dataset, "


@query(f"WITH {GUESSED}, {_kept(BD, 8)}, {_classes(BD)}, s AS ({SUMMARY.format(by=BD)} GROUP BY 1), a AS (SELECT dataset, count(*) AS n, avg((label = pred)::INT) AS accuracy FROM kept GROUP BY 1) SELECT dataset, n, round(accuracy, 9) AS accuracy, {R9} FROM s JOIN a USING (dataset)")
def by_dataset_metrics(spark, d):
    rows = classify.scored_rows(guessed(spark, d), "label", by=["dataset"], fewest=8)
    out = classify.summary(classify.per_class(rows, "label", "pred", by=["dataset"]), "dataset")
    acc = classify.accuracy_by(rows, F.col("label") == F.col("pred"), "dataset").drop("error_rate")
    return rounded(out.join(acc, "dataset"), "macro_f1", "weighted_f1", "accuracy")


@query(f"WITH {GUESSED}, r AS (SELECT dataset, label AS class, count(*) AS n_true, avg((label = pred)::INT) AS a FROM guessed GROUP BY 1, 2) SELECT dataset, class, n_true, round(a, 9) AS accuracy_recall, round(2 * a / (1 + a), 9) AS f1_true_rows_only FROM r")
def by_dataset_true_rows(spark, d):
    return rounded(classify.true_rows_only(guessed(spark, d), "label", "pred", "dataset"), "accuracy_recall", "f1_true_rows_only")


@query(f"""WITH {GUESSED}, x AS (SELECT * FROM predicted WHERE label <> 'L9'), y AS (SELECT * FROM guessed WHERE label <> 'L8'),
a AS (SELECT label AS class, avg((label = pred)::INT) AS v FROM x GROUP BY 1), b AS (SELECT label AS class, avg((label = pred)::INT) AS v FROM y GROUP BY 1)
SELECT class, round(a.v, 9) AS accuracy_recall_zeroshot, round(b.v, 9) AS accuracy_recall_adapted, round(b.v - a.v, 9) AS accuracy_recall_delta FROM a FULL JOIN b USING (class)""")
def full_outer_delta(spark, d):
    a = classify.true_rows_only(predicted(spark, d).where("label <> 'L9'"), "label", "pred")
    b = classify.true_rows_only(guessed(spark, d).where("label <> 'L8'"), "label", "pred")
    return rounded(classify.compared(a, b, "class", ["accuracy_recall"], ("zeroshot", "adapted")), "accuracy_recall_zeroshot", "accuracy_recall_adapted", "accuracy_recall_delta")


@query(f"WITH {GUESSED}, c AS (SELECT label, batch, count(*) AS n FROM guessed GROUP BY 1, 2), m AS (SELECT label, max(n) AS most, sum(n) AS a FROM c GROUP BY 1) SELECT round(sum(most) / sum(a)::DOUBLE, 9) AS baseline FROM m")
def majority_baseline(spark, d):
    return rounded(classify.majority_baseline(guessed(spark, d), "label", "batch"), "baseline")


@query(f"""WITH {GUESSED}, c AS (SELECT label AS a, pred AS b, count(*)::DOUBLE AS n FROM guessed GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
ea AS (SELECT DISTINCT a, na, t FROM m), eb AS (SELECT DISTINCT b, nb, t FROM m), s AS (SELECT (SELECT sum(n / t * ln(n * t / (na * nb))) FROM m) AS mi, (SELECT -sum(na / t * ln(na / t)) FROM ea) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM eb) AS hb,
(SELECT sum(n * (n - 1) / 2) FROM m) AS same, (SELECT sum(na * (na - 1) / 2) FROM ea) AS pa, (SELECT sum(nb * (nb - 1) / 2) FROM eb) AS pb, (SELECT max(t * (t - 1) / 2) FROM m) AS pairs)
SELECT round(2 * mi / (ha + hb), 8) AS nmi, round((same - pa * pb / pairs) / ((pa + pb) / 2 - pa * pb / pairs), 8) AS ari FROM s""")
def nmi_ari(spark, d):
    return rounded(classify.agreement(guessed(spark, d), "label", "pred"), "nmi", "ari", digits=8)


DIST = CENTRES + """, dist AS (SELECT a.label::VARCHAR AS cluster_a, b.label::VARCHAR AS cluster_b, list_distance(a.centre, b.centre) AS d FROM centres a JOIN centres b ON a.label < b.label)"""


def distances(spark, d):
    return distance.centroid_distances(latent(spark, d), "label", "embedding").withColumn("centroid_distance", F.round("centroid_distance", 9))


@query(f"WITH {DIST} SELECT cluster_a, cluster_b, 'embedding' AS latent_key, round(d, 9) AS centroid_distance FROM dist")
def centroid_distances(spark, d):
    return distances(spark, d)


LAB = """, dr AS (SELECT cluster_a, cluster_b, round(d, 9) AS d FROM dist), lab AS (SELECT DISTINCT label::VARCHAR AS cluster, CASE WHEN label % 3 = 0 THEN 'T' WHEN label = 7 THEN 'B' ELSE 'N' END AS label, CASE WHEN label % 4 = 0 THEN 'new' END AS alternative FROM embeddings)"""


def labels(spark, d):
    n = F.col("label")
    return latent(spark, d).select("label").distinct().select(n.cast("string").alias("cluster"), F.when(n % 3 == 0, F.lit("T")).when(n == 7, F.lit("B")).otherwise(F.lit("N")).alias("label"), F.when(n % 4 == 0, F.lit("new")).alias("alternative"))


FAR = "same AS (SELECT cluster_a, cluster_b, a.label AS label, d, quantile_cont(d, 0.8) OVER () AS thr FROM dr JOIN lab a ON cluster_a = a.cluster JOIN lab b ON cluster_b = b.cluster WHERE a.label = b.label)"


@query(f"WITH {DIST}{LAB}, {FAR} SELECT cluster_a, cluster_b, label, d AS centroid_distance, round(thr, 8) AS threshold, d >= thr AS selected FROM same")
def far_same_label_pairs(spark, d):
    return rounded(distance.far_same_label(distances(spark, d), labels(spark, d), quantile=0.8), "threshold", digits=8)


@query(f"""WITH {DIST}{LAB}, {FAR}, both_ways AS (SELECT cluster_a AS cluster, cluster_b AS other, d FROM dr UNION ALL SELECT cluster_b, cluster_a, d FROM dr),
j AS (SELECT e.cluster, e.other, e.d, m.label, coalesce(m.alternative, '') AS alternative, m.label = o.label AS same FROM both_ways e JOIN lab m ON e.cluster = m.cluster JOIN lab o ON e.other = o.cluster),
g AS (SELECT cluster, label, alternative, min(d) AS nd, arg_min(other, (d, other)) AS nc, min(d) FILTER (same) AS sd, arg_min(other, (d, other)) FILTER (same) AS sc, max(d) FILTER (same) AS fd, arg_min(other, (-d, other)) FILTER (same) AS fc FROM j GROUP BY 1, 2, 3),
th AS (SELECT (SELECT quantile_cont(d, 0.9) FROM dr) AS iso, (SELECT max(thr) FROM same) AS far),
e AS (SELECT g.*, (SELECT avg((d <= nd)::INT) FROM dr) AS pct, nd >= iso AS ifl, coalesce(fd >= far, false) AS sfl FROM g, th)
SELECT cluster, label, nc AS nearest_cluster, nd AS nearest_distance, round(pct, 9) AS isolation_percentile, ifl AS isolation_flag, sc AS nearest_same_label_cluster, sd AS nearest_same_label_distance, fc AS farthest_same_label_cluster, fd AS farthest_same_label_distance, sfl AS same_label_distance_flag, sfl OR ifl AS possible_novel_subtype, least(5, 3 * sfl::INT + 2 * ifl::INT + (alternative <> '')::INT) AS novelty_score FROM e""")
def novelty_evidence(spark, d):
    return rounded(distance.novelty_evidence(distances(spark, d), labels(spark, d), distance_quantile=0.8, isolation_quantile=0.9), "isolation_percentile")


def sampled_points(spark, d):
    """Points of three labels and two batches: all, or a proportional sample where there are more than the metrics are defined on."""
    k = F.col("id")
    p = points(spark, d).withColumns({"label": (k % 3).cast("string"), "batch": F.concat(F.lit("b"), (k % 7 % 2).cast("string"))})
    return sampling.proportional_sample(p, "label", "id", neighbors.MOST_POINTS)


FEW = """every AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z, (vec_id % 3)::VARCHAR AS label, 'b' || (vec_id % 7 % 2) AS batch FROM embeddings), sizes AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS t FROM every GROUP BY 1),
ranked_points AS (SELECT every.*, row_number() OVER (PARTITION BY every.label ORDER BY md5(id || '|0'), id) AS r, c, t FROM every JOIN sizes USING (label)), taken AS (SELECT * FROM ranked_points WHERE t <= 50000 OR r <= least(c, greatest(1, round_even(c / t::DOUBLE * 50000, 0)))),
few AS (SELECT id, z, label, batch FROM (SELECT *, row_number() OVER (ORDER BY md5(id || '|0t'), id) AS q FROM taken) WHERE q <= 50000), dd AS (SELECT a.id, b.id AS nid, a.label, b.label AS nl, a.batch, b.batch AS nb, list_distance(a.z, b.z) AS d FROM few a JOIN few b ON a.id <> b.id)"""


KNN = f"WITH {FEW}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS r FROM dd) WHERE r <= 10)"


@query(f"{KNN}, v AS (SELECT id, label, nl, count(*) AS c FROM nn GROUP BY 1, 2, 3), w AS (SELECT id, label, arg_min(nl, (-c, nl)) AS vote FROM v GROUP BY 1, 2) SELECT round(avg((vote = label)::INT), 9) AS knn_label_accuracy FROM w")
def knn_label_acc(spark, d):
    return rounded(neighbors.label_accuracy(sampled_points(spark, d), 10, "label"), "knn_label_accuracy")


BATCHED = f"WITH {FEW}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS r FROM dd WHERE label = nl) WHERE r <= 10), v AS (SELECT id, batch, nb, count(*) AS c FROM nn GROUP BY 1, 2, 3), w AS (SELECT id, batch, arg_min(nb, (-c, nb)) AS vote FROM v GROUP BY 1, 2), acc AS (SELECT sum((vote = batch)::INT) / count(*)::DOUBLE AS a FROM w)"


@query(f"{BATCHED} SELECT round(a, 9) AS knn_batch_accuracy FROM acc")
def knn_batch_acc(spark, d):
    return rounded(neighbors.within_label_batch_accuracy(sampled_points(spark, d), 10, "label", "batch"), "knn_batch_accuracy")


@query(f"{BATCHED}, c AS (SELECT label, batch, count(*) AS n FROM few GROUP BY 1, 2), m AS (SELECT label, max(n) AS most, sum(n) AS t FROM c GROUP BY 1), b AS (SELECT sum(most) / sum(t)::DOUBLE AS base FROM m) SELECT round(least(1, greatest(0, 1 - greatest(0, a - base) / (1 - base))), 8) AS knn_mixing FROM acc, b")
def knn_mixing(spark, d):
    p = sampled_points(spark, d)
    a, b = neighbors.within_label_batch_accuracy(p, 10, "label", "batch"), classify.majority_baseline(p, "label", "batch")
    return a.join(F.broadcast(b)).select(F.round(neighbors.mixing_score(F.col("knn_batch_accuracy"), F.col("baseline")), 8).alias("knn_mixing"))


@query(f"WITH {FEW}, m AS (SELECT id, label, nl, avg(d) AS d FROM dd GROUP BY 1, 2, 3), s AS (SELECT id, min(d) FILTER (label = nl) AS a, min(d) FILTER (label <> nl) AS b FROM m GROUP BY 1) SELECT round((avg((b - a) / greatest(a, b)) + 1) / 2, 6) AS label_asw FROM s")
def label_asw(spark, d):
    return rounded(neighbors.label_asw(sampled_points(spark, d), "label"), "label_asw", digits=6)


@query(f"WITH {FEW}, m AS (SELECT id, label, batch, nb, avg(d) AS d FROM dd WHERE label = nl GROUP BY 1, 2, 3, 4), s AS (SELECT id, label, min(d) FILTER (batch = nb) AS a, min(d) FILTER (batch <> nb) AS b FROM m GROUP BY 1, 2), l AS (SELECT label, 1 - abs(avg((b - a) / greatest(a, b))) AS v, count(*) AS n FROM s GROUP BY 1) SELECT round(sum(v * n) / sum(n), 6) AS batch_asw FROM l")
def batch_asw(spark, d):
    return rounded(neighbors.batch_asw(sampled_points(spark, d), "label", "batch"), "batch_asw", digits=6)


@query(f"""{KNN.replace('WITH', 'WITH RECURSIVE', 1).replace('r <= 10', 'r <= 5')}, e AS (SELECT id AS a, nid AS b FROM nn WHERE label = nl UNION SELECT nid, id FROM nn WHERE label = nl),
reach AS (SELECT id AS node, id AS root FROM few UNION SELECT e.b, root FROM reach JOIN e ON e.a = node), comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
parts AS (SELECT label, c, count(*) AS n FROM comp JOIN few ON node = id GROUP BY 1, 2), shares AS (SELECT label, max(n) / sum(n) AS share, sum(n) AS n FROM parts GROUP BY 1)
SELECT round(avg(share), 9) AS graph_connectivity FROM shares WHERE n >= 3""")
def graph_connectivity(spark, d):
    return rounded(neighbors.graph_connectivity(sampled_points(spark, d), 5, "label"), "graph_connectivity")


@query()
def pca_latent(spark, d):
    return cluster.principal_components(points(spark, d), 10)


@query()
def logistic_classifier(spark, d):
    """Learned from the training part of a stratified split, with class weights; all rows are told."""
    p = points(spark, d).withColumn("label", F.col("label").cast("string"))
    train = sampling.stratified_split(p, "label", "id", F.lit(False)).where("split = 'Train'")
    weights = recode.class_summary(train, "label").select("label", "weight")
    return cluster.logistic_labels(train.join(weights, "label"), p, label="label", vector="z", weight="weight")
