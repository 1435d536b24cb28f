"""Queries: recoding, composition, quality control, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import compose, qc, recode, sampling
from .registry import query
from .standins import CLEAN, COUNTS, OBS, counts, obs

FILL = "Flex Gene Expression"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LABELS = ["Mature Cytotoxic", "P", "Transitional Cytotoxic", "Unknown"]


def clean(spark, d):
    return obs(spark, d).withColumn("assay_clean", recode.clean_assay(F.col("assay"), FILL))


def _top(c):
    return f"""top_{c} AS (SELECT cluster, arg_min(v, (-n, v)) AS top, max(n) / sum(n)::DOUBLE AS frac, sum(n)::BIGINT AS n FROM (SELECT cluster, {c} AS v, count(*) AS n FROM clean GROUP BY 1, 2) GROUP BY 1)"""


WORKSHEET = f"""WITH {CLEAN}, {', '.join(_top(c) for c in ('label', 'tissue', 'dataset_id', 'assay_clean'))}, j AS (
  SELECT l.cluster, l.n AS n_cells, l.top AS top_label, l.frac AS top_label_frac, t.top AS top_tissue, t.frac AS top_tissue_frac, d.top AS top_dataset_id, d.frac AS top_dataset_id_frac, a.top AS top_assay_clean, a.frac AS top_assay_clean_frac
  FROM top_label l JOIN top_tissue t USING (cluster) JOIN top_dataset_id d USING (cluster) JOIN top_assay_clean a USING (cluster)
), k AS (SELECT *, CASE WHEN top_label = 'Transitional Cytotoxic' AND top_tissue IN ('decidua', 'lung') THEN 'Transitional Cytotoxic Tissue-Resident review'
    WHEN top_label = 'Mature Cytotoxic' AND top_assay_clean = '{FILL}' THEN 'Mature Cytotoxic Engineered review'
    WHEN top_label IN ('Mature Cytotoxic', 'Transitional Cytotoxic') THEN top_label ELSE top_label || ' review' END AS draft_refined_label,
  concat_ws(';', CASE WHEN top_tissue_frac >= 0.85 THEN 'high_tissue_specificity' END, CASE WHEN top_assay_clean_frac >= 0.85 THEN 'high_assay_specificity' END, CASE WHEN top_dataset_id_frac >= 0.75 THEN 'high_dataset_specificity' END, CASE WHEN top_label_frac < 0.70 THEN 'mixed_original_NK_State' END) AS review_notes FROM j)
SELECT *, CASE WHEN n_cells < 300 OR contains(draft_refined_label, 'review') OR contains(review_notes, 'high_dataset_specificity') THEN 'high'
  WHEN top_label_frac < 0.70 OR contains(review_notes, 'high_tissue_specificity') OR contains(review_notes, 'high_assay_specificity') THEN 'medium' ELSE 'low' END AS review_priority FROM k"""


@query(WORKSHEET)
def worksheet(spark, d):
    return compose.worksheet(clean(spark, d), "cluster", label="label", tissue="tissue", assay="assay_clean", dataset="dataset_id")


@query(f"WITH {CLEAN} SELECT assay_clean, count(*) AS n FROM clean GROUP BY 1")
def assay_clean_counts(spark, d):
    return clean(spark, d).groupBy("assay_clean").agg(F.count(F.lit(1)).alias("n"))


MERGED = CLEAN + """, c AS (SELECT dataset_id, assay_clean, count(*) AS n FROM clean GROUP BY 1, 2),
  main AS (SELECT dataset_id, arg_min(assay_clean, (-n, assay_clean)) AS top FROM c GROUP BY 1),
  merged AS (SELECT clean.*, CASE WHEN n < 28 THEN top ELSE assay_clean END AS assay_merged FROM clean JOIN c USING (dataset_id, assay_clean) JOIN main USING (dataset_id))"""


def merged(spark, d):
    return compose.merge_rare_assays(clean(spark, d), "dataset_id", "assay_clean", "assay_merged", 28)


@query(f"WITH {MERGED} SELECT dataset_id, assay_merged, dataset_id || ' || ' || assay_merged AS batch_composite, count(*) AS n FROM merged GROUP BY 1, 2, 3")
def dominant_assay_merge(spark, d):
    return merged(spark, d).withColumn("batch_composite", recode.composite(F.col("dataset_id"), F.col("assay_merged"))).groupBy("dataset_id", "assay_merged", "batch_composite").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLEAN}, c AS (SELECT dataset_id, assay_clean, count(*) AS n FROM clean GROUP BY 1, 2)
SELECT count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT assay_clean) AS n_assays, count(*) AS n_combos, count(*) FILTER (n < 100) AS n_below_warn, count(*) FILTER (n < 30) AS n_below_hard, count(*) FILTER (n >= 100) AS n_stable, count(DISTINCT dataset_id) * count(DISTINCT assay_clean) AS worst_case FROM c""")
def composite_profile(spark, d):
    return compose.batch_profile(clean(spark, d), "dataset_id", "assay_clean", warn=100, hard=30)


@query(f"WITH {OBS} SELECT cluster, " + ", ".join(f"count(*) FILTER (label = '{x}') AS \"{x}\"" for x in LABELS) + " FROM obs GROUP BY 1")
def crosstab_label(spark, d):
    return compose.crosstab(obs(spark, d), "cluster", "label", LABELS)


@query(f"WITH {CLEAN} SELECT dataset_id, " + ", ".join(f"round(log10(nullif(count(*) FILTER (assay_clean = '{x}'), 0)), 9) AS \"{x}\"" for x in [*PRIORITIES, FILL]) + " FROM clean GROUP BY 1")
def log10_pivot(spark, d):
    out = compose.log10_pivot(clean(spark, d), "dataset_id", "assay_clean", [*PRIORITIES, FILL])
    return out.select("dataset_id", *[F.round(F.col(f"`{x}`"), 9).alias(x) for x in [*PRIORITIES, FILL]])


def _weights(raw):
    return f"""w AS (SELECT label, count(*) AS n_cells, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM obs GROUP BY 1),
 v AS (SELECT *, least(greatest({raw}, 0.0001::DOUBLE), 10::DOUBLE) AS weight FROM w), class_weights AS (SELECT label, n_cells, percent, weight / (avg(weight) OVER () + 1e-8) AS weight FROM v)"""


@query(f"WITH {OBS}, {_weights('1.0::DOUBLE / sqrt(n_cells + 1e-8::DOUBLE)')} SELECT label, n_cells, round(percent, 9) AS percent, round(weight, 9) AS weight FROM class_weights")
def class_weights(spark, d):
    out = recode.class_summary(obs(spark, d), "label", low=0.0001)
    return out.select("label", "n_cells", F.round("percent", 9).alias("percent"), F.round("weight", 9).alias("weight"))


@query(f"WITH {OBS}, {_weights('1.0::DOUBLE / (percent + 1e-8::DOUBLE)')} SELECT label, CASE WHEN label = 'Unknown' THEN 0.0::DOUBLE ELSE round(least(greatest(weight, 0.25::DOUBLE), 1.0::DOUBLE), 9) END AS weight FROM class_weights")
def class_weight_vector(spark, d):
    o = obs(spark, d)
    out = recode.class_weight_vector(o, recode.class_summary(o, "label", mode="inv_percent", low=0.0001), "label")
    return out.select("label", F.round("weight", 9).alias("weight"))


SIZED = f"{OBS}, {COUNTS}, sized AS (SELECT obs.*, coalesce(library, 0) AS library FROM obs LEFT JOIN (SELECT cell_id, sum(count) AS library FROM counts GROUP BY 1) USING (cell_id))"


@query(f"WITH {SIZED} SELECT cell_id, library FROM sized WHERE library BETWEEN 20 AND 200")
def libsize_qc(spark, d):
    return qc.library_range(qc.library_sizes(obs(spark, d), counts(spark, d)), low=20.0, high=200.0).select("cell_id", "library")


@query(f"WITH {SIZED} SELECT cell_id, library FROM sized WHERE library >= 1 AND library <= (SELECT quantile_cont(library, 0.95) FROM sized)")
def libsize_quantile_qc(spark, d):
    return qc.library_range(qc.library_sizes(obs(spark, d), counts(spark, d)), low=1.0, quantile=0.95).select("cell_id", "library")


@query(f"WITH {CLEAN}, a AS (SELECT * FROM clean WHERE cluster IN (SELECT cluster FROM clean GROUP BY 1 HAVING count(*) >= 500)), b AS (SELECT * FROM a WHERE dataset_id IN (SELECT dataset_id FROM a GROUP BY 1 HAVING count(*) >= 100)) SELECT cluster, dataset_id, count(*) AS n FROM b GROUP BY 1, 2")
def min_class_batch_filter(spark, d):
    kept = qc.at_least(qc.at_least(clean(spark, d), "cluster", 500), "dataset_id", 100)
    return kept.groupBy("cluster", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


CAPS = {"P": 1000, "Mature Cytotoxic": 2000}


def _capped(src, seed="0"):
    return f"capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cell_id || '|{seed}'), cell_id) AS r FROM {src}) WHERE label NOT IN ('P', 'Mature Cytotoxic') OR r <= CASE label WHEN 'P' THEN 1000 ELSE 2000 END)"


@query(f"WITH {OBS}, {_capped('obs')} SELECT cell_id, label FROM capped")
def cap_classes(spark, d):
    return sampling.cap_classes(obs(spark, d), "label", "cell_id", CAPS).select("cell_id", "label")


def _major(src):
    return f"lim AS (SELECT count(*) FILTER (label = 'Transitional Cytotoxic') AS m, floor(0.25 * count(*) FILTER (label <> 'Transitional Cytotoxic')) AS t FROM {src}), halved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cell_id || '|0'), cell_id) AS rr FROM {src}), lim WHERE label <> 'Transitional Cytotoxic' OR NOT (t > 0 AND m > t) OR rr <= t)"


@query(f"WITH {OBS}, {_major('obs')} SELECT cell_id, label FROM halved")
def major_ratio(spark, d):
    return sampling.major_ratio(obs(spark, d), "label", "cell_id", "Transitional Cytotoxic", 0.25).select("cell_id", "label")


@query(f"""WITH {SIZED}, lib AS (SELECT * FROM sized WHERE library BETWEEN 1 AND 250), free AS (SELECT * FROM lib WHERE nation <> 3 AND label IN (SELECT label FROM lib WHERE nation <> 3 GROUP BY 1 HAVING count(*) >= 700)),
{_capped('free')}, {_major('capped')}, batch AS (SELECT * FROM halved WHERE dataset_id IN (SELECT dataset_id FROM halved GROUP BY 1 HAVING count(*) >= 100))
SELECT cell_id, label, dataset_id FROM batch UNION ALL SELECT cell_id, label, dataset_id FROM lib WHERE nation = 3""")
def qc_balance(spark, d):
    sized = qc.library_sizes(obs(spark, d), counts(spark, d))
    out = qc.qc_balance(sized, label="label", batch="dataset_id", protected=F.col("nation") == 3, low=1.0, high=250.0, min_class=700, caps=CAPS, major="Transitional Cytotoxic", ratio=0.25, min_batch=100)
    return out.select("cell_id", "label", "dataset_id")


SPLIT = OBS + """, strata AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM obs WHERE NOT nation < 5 GROUP BY label), train AS (SELECT *, (n - ceil(0.2 * n))::HUGEINT AS t FROM strata),
parts AS (SELECT *, c * t // n AS whole, row_number() OVER (ORDER BY c * t % n DESC, label NULLS LAST) AS place, t - sum(c * t // n) OVER () AS more FROM train),
vals AS (SELECT label, c - whole - (place <= more)::INT AS val FROM parts),
split AS (SELECT obs.*, CASE WHEN nation < 5 THEN 'Held-out' WHEN row_number() OVER (PARTITION BY nation < 5, obs.label ORDER BY md5(cell_id || '|0'), cell_id) <= val THEN 'Val' ELSE 'Train' END AS split FROM obs LEFT JOIN vals ON obs.label IS NOT DISTINCT FROM vals.label)"""


def split(spark, d):
    return sampling.stratified_split(obs(spark, d), "label", "cell_id", F.col("nation") < 5)


@query(f"WITH {SPLIT} SELECT cell_id, split FROM split")
def stratified_split(spark, d):
    return split(spark, d).select("cell_id", "split")


@query(f"WITH {SPLIT} SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN 'Train' ELSE split END AS split FROM split")
def split_reuse(spark, d):
    s = split(spark, d)
    return sampling.reuse_split(s.drop("split"), "cell_id", s.where("cell_id % 7 <> 0")).select("cell_id", "split")


@query(f"""WITH {OBS}, n AS (SELECT cluster, count(*) AS c, sum(count(*)) OVER () AS t FROM obs GROUP BY 1), k AS (SELECT cell_id, obs.cluster, row_number() OVER (PARTITION BY obs.cluster ORDER BY md5(cell_id || '|0'), cell_id) AS r, c, t FROM obs JOIN n USING (cluster)),
p AS (SELECT * FROM k WHERE t <= 801 OR r <= least(c, greatest(1, round_even(c / t::DOUBLE * 801, 0)))) SELECT cell_id, cluster FROM (SELECT *, row_number() OVER (ORDER BY md5(cell_id || '|0t'), cell_id) AS q FROM p) WHERE q <= 801""")
def proportional_subsample(spark, d):
    return sampling.proportional_sample(obs(spark, d), "cluster", "cell_id", 801).select("cell_id", "cluster")


@query(f"WITH {OBS} SELECT cell_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(cell_id || '|5'), cell_id) AS r FROM obs) WHERE r <= 20")
def sample_per_state(spark, d):
    return sampling.sample_per_group(obs(spark, d), "cluster", "cell_id", 20, 5).select("cell_id", "cluster")


@query(f"WITH {CLEAN}, t AS (SELECT DISTINCT assay_clean FROM clean WHERE nation >= 5 AND assay_clean <> '5-LOW') SELECT cell_id, assay_clean FROM clean WHERE nation < 5 AND assay_clean IN (SELECT assay_clean FROM t)")
def known_assay_semi(spark, d):
    c = clean(spark, d)
    return qc.known_only(c.where("nation < 5"), c.where("nation >= 5 AND assay_clean <> '5-LOW'"), "assay_clean").select("cell_id", "assay_clean")


@query(f"WITH {CLEAN}, t AS (SELECT DISTINCT assay_clean FROM clean WHERE nation >= 5 AND assay_clean <> '5-LOW') SELECT cell_id, label AS true_label, 'Unknown' AS label FROM clean WHERE nation < 5 AND assay_clean NOT IN (SELECT assay_clean FROM t)")
def new_assay_anti(spark, d):
    c = clean(spark, d)
    new = qc.new_only(c.where("nation < 5"), c.where("nation >= 5 AND assay_clean <> '5-LOW'"), "assay_clean")
    return recode.masked_label(new, "label", F.lit(True)).select("cell_id", F.col("label_true").alias("true_label"), "label")


@query(f"WITH {OBS} SELECT cell_id, label FROM obs WHERE label <> 'Unknown' AND label IN (SELECT label FROM obs WHERE nation >= 20)")
def evaluable_rows(spark, d):
    o = obs(spark, d)
    return qc.evaluable(o, "label", o.where("nation >= 20")).select("cell_id", "label")


@query(f"""WITH {OBS}, c AS (SELECT cluster, label, count(*) AS n FROM obs GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster)::DOUBLE AS fraction, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS rank FROM c)
SELECT cluster, rank, label, n AS n_cells, round(fraction, 9) AS fraction FROM r WHERE rank <= 2""")
def composition_topn(spark, d):
    return compose.top_composition(obs(spark, d), "cluster", "label", 2).select("cluster", "rank", "label", "n_cells", F.round("fraction", 9).alias("fraction"))


@query(f"""WITH {OBS}, r AS (SELECT 'nation' AS resolution, nation::VARCHAR AS k, count(*) AS n FROM obs GROUP BY 2 UNION ALL SELECT 'cluster', cluster, count(*) FROM obs GROUP BY 2)
SELECT resolution, count(*) AS n_clusters, min(n) AS min_cluster_size, max(n) AS max_cluster_size FROM r GROUP BY 1""")
def resolution_sizes(spark, d):
    return compose.size_range(obs(spark, d), ["nation", "cluster"])


@query("""WITH b AS (SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 1000 THEN 1 WHEN o_totalprice < 50000 THEN 2 WHEN o_totalprice < 150000 THEN 3 WHEN o_totalprice < 300000 THEN 4 WHEN o_totalprice <= 600000 THEN 5 END AS bin FROM orders)
SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def hist_fixed_edges(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(compose.histogram(F.col("o_totalprice"), [0, 1000, 50000, 150000, 300000, 600000]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (vec_id % 2)::DOUBLE AS v FROM embeddings), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT (x - x0) / (x1 - x0) * 10 AS u, (y - y0) / (y1 - y0) * 5 AS w, v FROM p, b), h AS (SELECT v, floor(u + 0.5) AS a1, floor(w + 0.5) AS b1, floor(u) AS a2, floor(w) AS b2, u, w FROM g),
k AS (SELECT v, ((u - a1) * (u - a1) + 3 * (w - b1) * (w - b1)) <= ((u - a2 - 0.5) * (u - a2 - 0.5) + 3 * (w - b2 - 0.5) * (w - b2 - 0.5)) AS f, a1, b1, a2, b2 FROM h)
SELECT CASE WHEN f THEN a1 ELSE a2 + 0.5 END AS hx, CASE WHEN f THEN b1 ELSE b2 + 0.5 END AS hy, count(*) AS n, round(avg(v), 9) AS mean FROM k GROUP BY 1, 2 HAVING count(*) >= 3""")
def hexbin_error(spark, d):
    p = spark.read.parquet(f"{d}/embeddings.parquet").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), (F.col("vec_id") % 2).cast("double").alias("v"))
    return compose.hexagons(p, "x", "y", "v", size=10, fewest=3).withColumn("mean", F.round("mean", 9))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS price, CASE WHEN min(p_size) > 1 THEN min(p_size)::DOUBLE END AS small FROM part GROUP BY 1)
SELECT p_brand, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price_scaled,
 round(CASE WHEN count(small) OVER () <= 1 THEN 1.0::DOUBLE WHEN small IS NULL THEN NULL WHEN max(small) OVER () = min(small) OVER () THEN 0.0::DOUBLE ELSE 1 - (small - min(small) OVER ()) / (max(small) OVER () - min(small) OVER ()) END, 6) AS small_scaled FROM m""")
def minmax_scores(spark, d):
    m = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.when(F.min("p_size") > 1, F.min("p_size").cast("double")).alias("small"))
    return m.select("p_brand", F.round(numbers.min_max_scaled(F.col("price")), 6).alias("price_scaled"), F.round(numbers.min_max_scaled(F.col("small"), lower_is_better=True), 6).alias("small_scaled"))


@query(f"WITH {OBS}, k AS (SELECT DISTINCT tissue FROM obs), c AS (SELECT tissue, row_number() OVER (ORDER BY tissue) - 1 AS code FROM k) SELECT tissue, code, count(*) AS n FROM obs JOIN c USING (tissue) GROUP BY 1, 2")
def label_codes(spark, d):
    return recode.sorted_codes(obs(spark, d), "tissue", "code").groupBy("tissue", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS}, m AS (SELECT count(*) AS n, cluster FROM obs GROUP BY 2) SELECT cluster, CASE cluster WHEN '0' THEN 'zero' WHEN '1' THEN 'one' ELSE cluster || ' review' END AS mapped, 'leiden_' || replace('0.4', '.', '_') AS resolution, n FROM m")
def mapped_labels(spark, d):
    m = obs(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return m.select("cluster", recode.map_default(F.col("cluster"), {"0": "zero", "1": "one"}).alias("mapped"), text.resolution_key(F.lit(0.4)).alias("resolution"), "n")
