"""Queries: normalisation, group means, rank-sum tests, marker tables, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, dendrogram, evidence, expression, latent, markers
from .registry import query
from .standins import COUNTS, EXPRESSED, OBS, counts, obs


def expressed(spark, d):
    return expression.normalise(counts(spark, d))


@query(f"WITH {COUNTS}, n AS (SELECT *, count / (sum(count) OVER (PARTITION BY cell_id)) * 10000 AS norm FROM counts) SELECT cell_id, gene, round(norm, 6) AS norm, round(ln(1 + norm), 6) AS x FROM n")
def normalize_log1p(spark, d):
    return expressed(spark, d).select("cell_id", "gene", F.round("norm", 6).alias("norm"), F.round("x", 6).alias("x"))


@query()
def latent_space(spark, d):
    """Ten columns of a latent space of all cells, from their centred log-normalised counts; tests hold it against the dense matrix."""
    scores, _, _ = latent.singular_vectors(expressed(spark, d), 10, most=5)
    return scores


SIZES = "sizes AS (SELECT cluster, count(*) AS n FROM obs GROUP BY 1)"
SUMS = "sums AS (SELECT cluster, gene, sum(x) AS s, count(*) AS nz FROM expressed JOIN obs USING (cell_id) GROUP BY 1, 2)"


@query(f"WITH {OBS}, {EXPRESSED}, {SIZES}, {SUMS} SELECT cluster, gene, round(s / n, 6) AS mean, round(nz / n::DOUBLE, 6) AS pct FROM sums JOIN sizes USING (cluster)")
def cluster_means(spark, d):
    return expression.group_means(expressed(spark, d), obs(spark, d), "cluster").select("cluster", "gene", F.round("mean", 6).alias("mean"), F.round("pct", 6).alias("pct"))


#: The stand-in for curated sets: genes by the length of their name.
CURATED = "length({}) % 3 = 0"


@query(f"""WITH {OBS}, {EXPRESSED}, {SIZES}, {SUMS}, m AS (SELECT cluster, gene, round(s / n, 6) AS mean FROM sums JOIN sizes USING (cluster) WHERE {CURATED.format('gene')}), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, gene) AS k FROM m)
SELECT cluster, string_agg(gene || '=' || format('{{:.6f}}', mean), ';' ORDER BY k) AS means, count(*) AS n FROM r WHERE k <= 30 GROUP BY 1""")
def curated_expression_means(spark, d):
    """The thirty largest means of curated genes' expression in each cluster, as a map that is shown in its order."""
    m = expression.group_means(expressed(spark, d), obs(spark, d), "cluster").where(CURATED.format("gene")).withColumn("mean", F.round("mean", 6))
    maps = evidence.top_numbers(m, "cluster", "gene", "mean", 30)
    shown_ = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    return maps.select("cluster", F.array_join(shown_, ";").alias("means"), F.size("values").cast("long").alias("n"))


GRID = f"""WITH {OBS}, {EXPRESSED}, {SIZES}, {SUMS}, tot AS (SELECT sum(n) AS t FROM sizes), g AS (SELECT gene, sum(s) AS sa, sum(nz) AS nza FROM sums GROUP BY 1),
f AS (SELECT cluster, gene, coalesce(s, 0) AS s, coalesce(nz, 0) AS nz, sa, nza, n, t FROM g CROSS JOIN sizes CROSS JOIN tot LEFT JOIN sums USING (cluster, gene))"""


@query(f"{GRID} SELECT cluster, gene, round(log2((exp(s / n) - 1 + 1e-9) / (exp((sa - s) / (t - n)) - 1 + 1e-9)), 6) AS logfc, round(nz / n::DOUBLE, 6) AS pct_group, round((nza - nz) / (t - n)::DOUBLE, 6) AS pct_rest FROM f")
def pct_nonzero_logfc(spark, d):
    out = expression.fold_changes(expressed(spark, d), obs(spark, d), "cluster")
    return out.select("cluster", "gene", *[F.round(c, 6).alias(c) for c in ("logfc", "pct_group", "pct_rest")])


@query(f"""WITH {OBS}, {EXPRESSED}, {SIZES}, {SUMS}, m AS (SELECT cluster, gene, s / n AS mean FROM sums JOIN sizes USING (cluster)), r AS (SELECT *, min(mean) OVER (PARTITION BY gene) AS lo, max(mean) OVER (PARTITION BY gene) AS hi FROM m)
SELECT cluster, gene, round(coalesce((mean - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM r""")
def dotplot_scaled(spark, d):
    means = expression.group_means(expressed(spark, d), obs(spark, d), "cluster")
    return expression.scaled_by_gene(means).select("cluster", "gene", F.round("scaled", 6).alias("scaled"))


def _rank_sql(group, cells, by="", on=""):
    """Rank sums from the ranks of all cells that have a gene, zeros by their number."""
    return f"""v AS (SELECT {by}gene, {group} AS grp, round(x, 9) AS x FROM expressed JOIN {cells} USING (cell_id)), r AS (SELECT *, rank() OVER (PARTITION BY {by}gene ORDER BY x) + (count(*) OVER (PARTITION BY {by}gene, x) - 1) / 2.0::DOUBLE AS mr, count(*) OVER (PARTITION BY {by}gene, x) AS t, count(*) OVER (PARTITION BY {by}gene) AS nnz FROM v),
na AS (SELECT {by}count(*)::DOUBLE AS n FROM {cells} {'GROUP BY ' + by[:-2] if by else ''}), gs AS (SELECT {by}{group} AS grp, count(*)::DOUBLE AS ng FROM {cells} GROUP BY {by}{group}),
ge AS (SELECT {by}gene, max(nnz)::DOUBLE AS nnz, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY {by}gene), gg AS (SELECT {by}gene, grp, sum(mr) AS s, count(*) AS c FROM r GROUP BY {by}gene, grp),
al AS (SELECT {by}grp, gene, n, ng, nnz, n - nnz AS z0, ties, coalesce(s, 0) AS s, coalesce(c, 0) AS c FROM ge {'JOIN na USING (pair) JOIN gs USING (pair)' if by else 'CROSS JOIN na CROSS JOIN gs'} LEFT JOIN gg USING ({by}gene, grp)),
zs AS (SELECT *, s + c * z0 + (ng - c) * (z0 + 1) / 2 AS rs, (1 - (ties + z0 * z0 * z0 - z0) / (n * n * n - n)) * ng * (n - ng) * (n + 1) / 12 AS va FROM al),
z AS (SELECT {by}grp, gene, (rs - ng * (n + 1) / 2) / sqrt(CASE WHEN va > 1e-9 THEN va END) AS z FROM zs)"""


ZSQL = f"WITH {OBS}, {EXPRESSED}, {_rank_sql('label', 'obs')}"


def z_scores(spark, d):
    return markers.rank_sum(expressed(spark, d), obs(spark, d), "label")


@query(f"{ZSQL} SELECT grp AS label, gene, round(z, 5) AS z FROM z")
def wilcoxon_z(spark, d):
    return z_scores(spark, d).select("label", "gene", F.round("z", 5).alias("z"))


def _adjusted_sql(src, by):
    """Adjusted p values of rows src (by, gene, z), by the complementary error function's series and continued fraction."""
    x = "(abs(z) / sqrt(2::DOUBLE))"
    inner = f"list_reduce([1.0::DOUBLE] || range(60, 0, -1)::DOUBLE[], lambda a, k: 1 + a * 2 * {x} * {x} / (2 * k + 1))"
    outer = f"list_reduce([0.0::DOUBLE] || range(60, 0, -1)::DOUBLE[], lambda a, k: (k / 2) / ({x} + a))"
    return f"""pv AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN {x} < 3 THEN 1 - 2 / sqrt(pi()) * {x} * exp(-{x} * {x}) * {inner} ELSE exp(-{x} * {x}) / sqrt(pi()) / ({x} + {outer}) END AS p FROM {src}),
qv AS (SELECT *, p * count(p) OVER (PARTITION BY {by}) / count(p) OVER (PARTITION BY {by} ORDER BY p RANGE UNBOUNDED PRECEDING) AS q FROM pv),
table_ AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, min(q) OVER (PARTITION BY {by} ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adj FROM qv)"""


#: Ranks, fold changes and shares of each label, and their adjusted p values.
MARKERS = f"""{ZSQL}, {SIZES.replace('cluster', 'label').replace('sizes AS', 'lsizes AS')}, {SUMS.replace('cluster', 'label').replace('sums AS', 'lsums AS')},
lg AS (SELECT gene, sum(s) AS sa, sum(nz) AS nza FROM lsums GROUP BY 1), lt AS (SELECT sum(n) AS t FROM lsizes),
lf AS (SELECT label, gene, coalesce(s, 0) AS s, coalesce(nz, 0) AS nz, sa, nza, n, t FROM lg CROSS JOIN lsizes CROSS JOIN lt LEFT JOIN lsums USING (label, gene)),
full_ AS (SELECT label, lf.gene, z, log2((exp(s / n) - 1 + 1e-9) / (exp((sa - s) / (t - n)) - 1 + 1e-9)) AS logfc, nz / n::DOUBLE AS pct_group, (nza - nz) / (t - n)::DOUBLE AS pct_rest FROM lf JOIN z ON z.grp = lf.label AND z.gene = lf.gene),
fz AS (SELECT * REPLACE (round(z, 5) AS z, round(logfc, 5) AS logfc) FROM full_),
{_adjusted_sql('fz', 'label')}"""


def marker_table_rows(spark, d):
    """The marker table of each label; scores are rounded, so that ties and p values do not hang on the last digit."""
    scores = markers.marker_scores(expressed(spark, d), obs(spark, d), "label")
    return markers.with_p_values(scores.withColumns({"z": F.round("z", 5), "logfc": F.round("logfc", 5)}), "label")


SHOWN = "z, round(p, 9) AS p, round(p_adj, 9) AS p_adj, logfc, round(pct_group, 6) AS pct_group, round(pct_rest, 6) AS pct_rest"


def shown(df):
    return df.withColumns({"p": F.round("p", 9), "p_adj": F.round("p_adj", 9), "pct_group": F.round("pct_group", 6), "pct_rest": F.round("pct_rest", 6)})


@query(f"{MARKERS} SELECT label, gene, {SHOWN} FROM table_")
def marker_table(spark, d):
    return shown(marker_table_rows(spark, d)).select("label", "gene", "z", "p", "p_adj", "logfc", "pct_group", "pct_rest")


@query(f"{MARKERS} SELECT label, gene, round(p, 9) AS p, round(p_adj, 9) AS p_adj FROM table_")
def marker_p_values(spark, d):
    z = z_scores(spark, d).withColumn("z", F.round("z", 5))
    return markers.with_p_values(z, "label").select("label", "gene", F.round("p", 9).alias("p"), F.round("p_adj", 9).alias("p_adj"))


@query(f"{MARKERS} SELECT label, gene, z, logfc FROM table_ WHERE round(p_adj, 9) < 0.9 AND logfc > 0")
def significant_up(spark, d):
    """Of these random stand-ins no adjusted p value is small, so the bound is loose."""
    return markers.significant_up(shown(marker_table_rows(spark, d)), most=0.9).select("label", "gene", "z", "logfc")


@query(f"""{MARKERS}, ups AS (SELECT label, gene, z FROM table_ WHERE round(p_adj, 9) < 0.9 AND logfc > 0), placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, gene) AS k FROM ups)
SELECT gene, min(label) AS first_label FROM placed WHERE k <= 5 GROUP BY 1""")
def plot_markers(spark, d):
    """Genes for a plot: the first five of each label among those significantly up, each once, with the label that has it first. The bound is loose, as in significant_up."""
    ups = markers.significant_up(shown(marker_table_rows(spark, d)), most=0.9)
    top = markers.top_markers(ups, "label", 5, [F.desc("z"), F.col("gene")])
    return evidence.ordered_union(top, "gene", F.col("label")).withColumnRenamed("place", "first_label")


@query(f"{MARKERS}, placed AS (SELECT label, gene, z, logfc, row_number() OVER (PARTITION BY label ORDER BY z DESC NULLS LAST, gene) AS rank FROM table_ WHERE logfc > 0) SELECT * FROM placed WHERE rank <= 10")
def top_up_markers(spark, d):
    top = markers.top_markers(marker_table_rows(spark, d), "label", 10, [F.desc_nulls_last("z"), F.col("gene")], only_up="logfc")
    return top.select("label", "gene", "z", "logfc", "rank")


@query(f"{MARKERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC NULLS LAST, gene) AS rank FROM table_) SELECT label, string_agg(gene || ':' || round(pct_group, 4), ';' ORDER BY rank) AS records, count(*) AS n FROM placed WHERE rank <= 6 GROUP BY 1")
def marker_records(spark, d):
    top = markers.top_markers(marker_table_rows(spark, d), "label", 6, [F.desc_nulls_last("z"), F.col("gene")])
    out = markers.records(top, "label", k=6)
    text = F.transform("records", lambda r: F.concat(r["gene"], F.lit(":"), F.round(r["pct_group"], 4).cast("string")))
    return out.select("label", F.array_join(text, ";").alias("records"), F.size("names").cast("long").alias("n"))


@query("""WITH g AS (SELECT o_orderstatus AS grp, o_orderkey AS id, round((o_orderkey * 7919 % 1000) / 1000.0::DOUBLE, 3) AS p FROM orders),
q AS (SELECT *, p * count(p) OVER (PARTITION BY grp) / count(p) OVER (PARTITION BY grp ORDER BY p RANGE UNBOUNDED PRECEDING) AS q FROM g)
SELECT grp, id, p, round(least(1.0::DOUBLE, min(q) OVER (PARTITION BY grp ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adj FROM q""")
def bh_adjust(spark, d):
    k = F.col("o_orderkey")
    g = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("grp"), k.alias("id"), F.round((k * 7919 % 1000) / F.lit(1000.0), 3).alias("p"))
    return markers.adjusted(g, "p", "grp").withColumn("p_adj", F.round("p_adj", 9))


@query(f"{ZSQL} SELECT grp AS label, gene, rank, z FROM (SELECT grp, gene, round(z, 5) AS z, row_number() OVER (PARTITION BY grp ORDER BY round(z, 5) DESC, gene) AS rank FROM z WHERE z IS NOT NULL) WHERE rank <= 10")
def top_markers(spark, d):
    z = z_scores(spark, d).where("z IS NOT NULL").withColumn("z", F.round("z", 5))
    return markers.top_markers(z, "label", 10, [F.desc("z"), F.col("gene")]).select("label", "gene", "rank", "z")


PAIRS = [("0", "1"), ("2", "10"), ("1", "7")]
PAIR_CELLS = "pairs AS (SELECT * FROM (VALUES ('0_vs_1', '0', '1'), ('2_vs_10', '2', '10'), ('1_vs_7', '1', '7')) t(pair, a, b)), pc AS (SELECT cell_id, cluster, pair FROM obs JOIN pairs ON cluster = a OR cluster = b)"


PAIR_TABLE = f"""WITH {OBS}, {EXPRESSED}, {PAIR_CELLS}, {_rank_sql('cluster', 'pc', by='pair, ')},
ps AS (SELECT pair, cluster, count(*) AS n FROM pc GROUP BY 1, 2), pt AS (SELECT pair, sum(n) AS t FROM ps GROUP BY 1), pm AS (SELECT pair, cluster, gene, sum(x) AS s, count(*) AS nz FROM expressed JOIN pc USING (cell_id) GROUP BY 1, 2, 3),
pg AS (SELECT pair, gene, sum(s) AS sa, sum(nz) AS nza FROM pm GROUP BY 1, 2), pf AS (SELECT pair, cluster, gene, coalesce(s, 0) AS s, coalesce(nz, 0) AS nz, sa, nza, n, t FROM pg JOIN ps USING (pair) JOIN pt USING (pair) LEFT JOIN pm USING (pair, cluster, gene)),
pz AS (SELECT pf.pair, cluster, pf.gene, round(z, 5) AS z, round(log2((exp(s / n) - 1 + 1e-9) / (exp((sa - s) / (t - n)) - 1 + 1e-9)), 5) AS logfc, nz / n::DOUBLE AS pct_group, (nza - nz) / (t - n)::DOUBLE AS pct_rest FROM pf JOIN z ON z.pair = pf.pair AND z.grp = cluster AND z.gene = pf.gene),
{_adjusted_sql('pz', 'pair, cluster')}"""


def pair_table(spark, d, done=None):
    pairs = spark.createDataFrame([(f"{a}_vs_{b}", a, b) for a, b in PAIRS], "pair string, a string, b string")
    out = markers.pair_markers(expressed(spark, d), obs(spark, d), "cluster", pairs, done=done).drop("p", "p_adj")
    return markers.with_p_values(out.withColumns({"z": F.round("z", 5), "logfc": F.round("logfc", 5)}), "pair", "cluster")


@query(f"{PAIR_TABLE} SELECT pair, cluster, gene, rank, z, logfc FROM (SELECT *, row_number() OVER (PARTITION BY pair, cluster ORDER BY z DESC NULLS LAST, gene) AS rank FROM table_ WHERE logfc > 0) WHERE rank <= 100")
def pair_markers(spark, d):
    top = markers.top_markers(pair_table(spark, d), ["pair", "cluster"], 100, [F.desc_nulls_last("z"), F.col("gene")], only_up="logfc")
    return top.select("pair", "cluster", "gene", "rank", "z", "logfc")


@query(f"{PAIR_TABLE} SELECT pair, cluster, gene, {SHOWN} FROM table_ WHERE pair <> '1_vs_7'")
def pair_table_of_new_pairs(spark, d):
    """The whole table of the pairs whose results are not there yet."""
    out = pair_table(spark, d, done=spark.createDataFrame([("1_vs_7",)], "pair string"))
    return shown(out).select("pair", "cluster", "gene", "z", "p", "p_adj", "logfc", "pct_group", "pct_rest")


@query(f"WITH {OBS}, s AS (SELECT cluster, count(*) AS n FROM obs GROUP BY 1) SELECT pair, a, b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM (VALUES ('0_vs_1', '0', '1'), ('2_vs_10', '2', '10'), ('1_vs_7', '1', '7'), ('3_vs_none', '3', 'none')) t(pair, a, b) LEFT JOIN s x ON x.cluster = a LEFT JOIN s y ON y.cluster = b")
def pair_metadata(spark, d):
    pairs = spark.createDataFrame([*((f"{a}_vs_{b}", a, b) for a, b in PAIRS), ("3_vs_none", "3", "none")], "pair string, a string, b string")
    return markers.pair_metadata(obs(spark, d), "cluster", pairs)


WEIGHT = "((ascii(p_name) * 31 + length(p_name) * 17 + length(label) * 7) % 100)::DOUBLE / 50 - 1"
ATTR = f"""WITH {OBS}, {EXPRESSED}, states AS (SELECT DISTINCT label FROM obs WHERE label <> 'Unknown'), weights AS (SELECT DISTINCT label AS state, p_name AS gene, {WEIGHT} AS weight FROM part, states),
sel AS (SELECT cell_id, label AS state FROM obs WHERE label <> 'Unknown'), nsel AS (SELECT state, count(*) AS n_cells FROM sel GROUP BY 1),
base AS (SELECT gene, sum(x) / (SELECT count(*) FROM obs)::DOUBLE AS b FROM expressed GROUP BY 1), have AS (SELECT state, gene, sum(x - b) AS s, sum(abs(x - b)) AS a, count(*) AS nz FROM expressed JOIN sel USING (cell_id) JOIN base USING (gene) GROUP BY 1, 2),
attr AS (SELECT state, gene, (coalesce(s, 0) - (n_cells - coalesce(nz, 0)) * b) * weight / n_cells AS mean_attr, (coalesce(a, 0) + (n_cells - coalesce(nz, 0)) * abs(b)) * abs(weight) / n_cells AS mean_abs_attr, n_cells FROM weights JOIN base USING (gene) JOIN nsel USING (state) LEFT JOIN have USING (state, gene)),
rounded AS (SELECT state, gene, round(mean_attr, 6) AS mean_attr, round(mean_abs_attr, 6) AS mean_abs_attr, n_cells FROM attr), ranked AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY mean_abs_attr DESC, gene) AS rank FROM rounded)"""
STATES = ["Mature Cytotoxic", "P", "Transitional Cytotoxic"]


def attributed(spark, d):
    o = obs(spark, d)
    states = o.where("label <> 'Unknown'").select("label").distinct()
    genes = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct()
    weight = ((F.ascii("p_name") * 31 + F.length("p_name") * 17 + F.length("label") * 7) % 100).cast("double") / 50 - 1
    weights = genes.join(F.broadcast(states)).select(F.col("label").alias("state"), F.col("p_name").alias("gene"), weight.alias("weight"))
    x = expressed(spark, d)
    n = o.agg(F.count(F.lit(1)).alias("n"))
    base = x.groupBy("gene").agg(F.sum("x").alias("s")).join(F.broadcast(n)).select("gene", (F.col("s") / F.col("n")).alias("baseline"))
    selected = o.where("label <> 'Unknown'").select("cell_id", F.col("label").alias("state"))
    attr = attribution.linear_attribution(x, selected, weights, base)
    return attribution.ranked(attr.withColumns({c: F.round(c, 6) for c in ("mean_attr", "mean_abs_attr")}))


@query(f"{ATTR} SELECT state, gene, rank, mean_attr, mean_abs_attr, n_cells, CASE WHEN mean_attr >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM ranked WHERE rank <= 10")
def attribution_top(spark, d):
    return attributed(spark, d).where("rank <= 10").select("state", "gene", "rank", "mean_attr", "mean_abs_attr", "n_cells", "direction")


@query(ATTR + " SELECT gene, " + ", ".join(f"max(mean_abs_attr) FILTER (state = '{s}') AS \"{s}_attr\", max(rank) FILTER (state = '{s}') AS \"{s}_rank\"" for s in STATES) + ", round(avg(rank), 6) AS mean_rank FROM ranked GROUP BY 1")
def attribution_rank_wide(spark, d):
    return attribution.wide(attributed(spark, d), STATES).withColumn("mean_rank", F.round("mean_rank", 6))


@query(f"""{ATTR}, c AS (SELECT *, max(mean_abs_attr) OVER (PARTITION BY state) AS top, sum(mean_abs_attr) OVER (PARTITION BY state) AS tot, sum(mean_abs_attr) OVER (PARTITION BY state ORDER BY rank) AS sofar, count(*) OVER (PARTITION BY state) AS k FROM ranked),
e AS (SELECT *, least(greatest(sum((mean_abs_attr >= 0.6 * top)::INT) OVER (PARTITION BY state), 3), 20, k) AS n_selected FROM c) SELECT state, gene, rank, n_selected::BIGINT AS n_selected, round(sofar / tot, 6) AS cumulative_share FROM e WHERE rank <= n_selected""")
def relative_to_top(spark, d):
    out = attribution.relative_to_top(attributed(spark, d), share=0.6, fewest=3, most=20)
    return out.select("state", "gene", "rank", F.col("n_selected").cast("long").alias("n_selected"), F.round("cumulative_share", 6).alias("cumulative_share"))


def heatmap(spark, d):
    """The genes that a heat map shows: the first twenty of each state, with their mean attribution in every state."""
    every = attributed(spark, d)
    return every.join(every.where("rank <= 20").select("gene").distinct(), "gene", "left_semi")


_TOPS = ", ".join(f"{{'size': -abs(coalesce(max(mean_attr) FILTER (state = '{s}'), 0)), 'state': {k}, 'signed': -coalesce(max(mean_attr) FILTER (state = '{s}'), 0)}}" for k, s in enumerate(STATES))


@query(f"""{ATTR}, tops AS (SELECT gene, list_min([{_TOPS}]) AS t FROM ranked WHERE gene IN (SELECT gene FROM ranked WHERE rank <= 20) GROUP BY 1)
SELECT gene, row_number() OVER (ORDER BY t.state, t.size, t.signed, gene) AS place FROM tops""")
def heatmap_columns_by_state(spark, d):
    return dendrogram.ordered_columns(heatmap(spark, d), STATES, mode="max_state", value="mean_attr")


@query()
def heatmap_columns_clustered(spark, d):
    """In the order of Ward's tree; tests hold that against all pairs."""
    return dendrogram.ordered_columns(heatmap(spark, d), STATES, value="mean_attr")


@query(f"{ATTR} SELECT gene, arg_min(state, (-mean_abs_attr, state)) AS state, max(mean_abs_attr) AS value FROM ranked GROUP BY 1")
def strongest_state(spark, d):
    return attribution.strongest_state(attributed(spark, d))


@query("""WITH n AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'mt-' || p_name WHEN 1 THEN 'RPS' || p_partkey WHEN 2 THEN 'Malat1' WHEN 3 THEN 'HBA1' WHEN 4 THEN 'HBBX' ELSE p_name END AS gene FROM part)
SELECT gene FROM n WHERE NOT (upper(gene) IN ('MALAT1', 'B2M', 'TMSB4X', 'HBB') OR regexp_matches(upper(gene), '^(MT-|RPS|RPL|HBA)'))""")
def broad_gene_filter(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    gene = F.when(k % 6 == 0, F.concat(F.lit("mt-"), name)).when(k % 6 == 1, F.concat(F.lit("RPS"), k.cast("string"))).when(k % 6 == 2, F.lit("Malat1")).when(k % 6 == 3, F.lit("HBA1")).when(k % 6 == 4, F.lit("HBBX")).otherwise(name)
    genes = spark.read.parquet(f"{d}/part.parquet").select(gene.alias("gene")).distinct()
    return genes.where(~attribution.broad_gene(F.col("gene")))
