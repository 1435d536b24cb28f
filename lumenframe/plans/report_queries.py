"""Queries: evidence, mapping, validation and status tables, selections, and metrics put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles, compose, evidence, markers, recode, reports, review, selection, vocabulary
from . import evaluation_queries as ev
from . import registry
from .composition import CLEAN, MERGED, SPLIT, WORKSHEET, clean, merged, split
from .registry import query
from .review_queries import DECISIONS, HELD, KINDS, KNOWN, PROGRAM_ROWS, TRIAGE, _list, held
from .standins import OBS, obs

WORK = f"w AS ({WORKSHEET})"
NOVEL = f"nov AS ({registry.ORACLES['novelty_evidence']})"
DECIDED = f"dec AS (SELECT cluster, {_list(KINDS)}[(cluster::INT % 6 + 1)::INT] AS decision FROM w),\n" + DECISIONS.split("\n", 1)[1]


def number():
    return F.col("cluster").cast("int")


def work(spark, d):
    return compose.worksheet(clean(spark, d), "cluster", label="label", tissue="tissue", assay="assay_clean", dataset="dataset_id")


def decided(spark, d):
    """A decision on each group of the worksheet."""
    rows = obs(spark, d).select("cluster").distinct().select("cluster", F.get(F.lit(KINDS), number() % 6).alias("decision"))
    return review.normalised(rows)


def known_evidence(spark, d):
    novel = registry.QUERIES["novelty_evidence"](spark, d)
    reason = reports.novelty_reason(F.col("same_label_distance_flag"), F.col("isolation_flag"), F.col("nearest_cluster"))
    reasons = novel.select("cluster", reason.alias("novel_subtype_reason"))
    w = work(spark, d).withColumns({"note": F.when(number() % 4 == 0, F.lit("high_assay_specificity;odd")), "n_pairs": number() % 3})
    return reports.evidence_table(w, reports.distance_lookup(novel), reasons)


EVIDENCE = f"""{NOVEL}, ev AS (SELECT w.*, CASE WHEN cluster::INT % 4 = 0 THEN 'mostly from one assay; odd' END AS note, cluster::INT % 3 AS n_pairs, nov.possible_novel_subtype, nov.novelty_score, nov.nearest_cluster, nov.nearest_distance,
  CASE WHEN nov.cluster IS NOT NULL THEN concat_ws('; ', CASE WHEN same_label_distance_flag THEN 'far from a cluster of the same label' END, CASE WHEN isolation_flag THEN 'isolated; nearest is ' || nearest_cluster END) END AS novel_subtype_reason FROM w LEFT JOIN nov USING (cluster))"""


@query(f"WITH {WORK}, {EVIDENCE} SELECT cluster, n_cells, top_label, draft_refined_label, review_priority, n_pairs, possible_novel_subtype, novelty_score, nearest_cluster, nearest_distance, novel_subtype_reason FROM ev")
def evidence_assembly(spark, d):
    return known_evidence(spark, d).select("cluster", "n_cells", "top_label", "draft_refined_label", "review_priority", "n_pairs", "possible_novel_subtype", "novelty_score", "nearest_cluster", "nearest_distance", "novel_subtype_reason")


MAPPING = f"""WITH {WORK}, {EVIDENCE}, {DECIDED}, r AS (SELECT norm.*, ev.* EXCLUDE (cluster), j, norm.needs_human_review OR confidence_score < 4 OR technical_concern_score >= 2 OR suggested_new_label <> '' AS need FROM norm JOIN ev USING (cluster) JOIN m USING (cluster)),
s AS (SELECT *, concat_ws('; ', CASE WHEN confidence_score < 4 THEN 'confidence ' || confidence_score || '<4' END, CASE WHEN technical_concern_score >= 2 THEN 'technical concern ' || technical_concern_score || '/5' END, CASE WHEN suggested_new_label <> '' THEN 'suggested new label: ' || suggested_new_label END, note) AS ask,
concat_ws('; ', 'confident approved label (' || confidence_score || '/5)', CASE WHEN ambiguity_score <= 2 THEN 'low ambiguity (' || ambiguity_score || '/5)' END, CASE WHEN technical_concern_score < 2 THEN 'low technical concern (' || technical_concern_score || '/5)' END, CASE WHEN n_pairs > 0 THEN 'reviewed ' || n_pairs || ' pairwise DE comparison(s)' END) AS fine FROM r),
mapping AS (SELECT cluster, candidate_label AS candidate_refined_label, need AS needs_human_review, CASE WHEN NOT need THEN fine WHEN ask = '' AND needs_human_review THEN 'model uncertainty' ELSE ask END AS review_reason, n_cells, top_label AS top_original_label, top_label_frac AS top_original_label_frac,
  confidence_score AS confidence_score_0_5, ambiguity_score AS ambiguity_score_0_5, technical_concern_score AS technical_concern_score_0_5, top_tissue, draft_refined_label AS worksheet_initial_draft_label, 1 + cluster::INT % 2 AS n_iterations, n_pairs AS "n_pairwise_DE_compared",
  coalesce(possible_novel_subtype, false) AS possible_novel_subtype, coalesce(novelty_score, 0) AS novel_subtype_score_0_5, coalesce(novel_subtype_reason, '') AS novel_subtype_reason, coalesce(nullif(suggested_new_label, ''), 'None') AS alternative_name_suggestion,
  CASE WHEN new_label_reason <> '' THEN new_label_reason WHEN suggested_new_label <> '' THEN '{vocabulary.OTHER_NAME}' ELSE '{vocabulary.NO_OTHER_NAME}' END AS alternative_name_reason,
  array_to_string(coalesce(try_cast(j->'recommended_pairwise_comparisons' AS VARCHAR[]), []), '; ') AS recommended_pairwise_comparisons FROM s)"""


def mapping(spark, d):
    return reports.mapping_table(decided(spark, d).withColumn("n_iterations", 1 + number() % 2), known_evidence(spark, d))


@query(f"{MAPPING} SELECT * FROM mapping")
def mapping_table(spark, d):
    return mapping(spark, d)


@query(f"{MAPPING} SELECT coalesce(nullif(string_agg(cluster || ': ' || alternative_name_suggestion, '; ' ORDER BY cluster::INT), ''), 'none') AS alternatives FROM mapping WHERE lower(alternative_name_suggestion) <> 'none'")
def alternative_summary(spark, d):
    return reports.alternatives(mapping(spark, d), [number()])


@query(f"WITH {WORK}, {DECIDED} SELECT cluster, candidate_label, confidence_score, ambiguity_score, technical_concern_score, {TRIAGE} AS review_status, needs_human_review, coalesce(nullif(suggested_new_label, ''), 'None') AS suggested_new_label FROM norm")
def status_table(spark, d):
    return reports.status_table(decided(spark, d))


PHRASES = "ph AS (SELECT cluster, CASE WHEN json_type(j->'evidence_summary') = 'VARCHAR' THEN [j->>'evidence_summary'] ELSE coalesce(try_cast(j->'evidence_summary' AS VARCHAR[]), []) END AS evidence, trim(coalesce(j->>'stop_reason', '')) AS stop FROM m)"


@query(f"WITH {WORK}, {DECIDED}, {PHRASES} SELECT cluster, concat_ws(' | Decision: ', nullif(array_to_string(evidence, '; '), ''), nullif(stop, '')) AS reasoning FROM ph")
def agent_reasoning(spark, d):
    return decided(spark, d).select("cluster", reports.reasoning(F.col("evidence_summary"), F.col("stop_reason")).alias("reasoning"))


@query(f"""WITH {WORK}, {DECIDED}, {PHRASES}, x AS (SELECT candidate_label, cluster::INT AS c, i, rtrim(trim(evidence[i]), '.') AS phrase FROM ph JOIN norm USING (cluster), range(1, 20) t(i) WHERE i <= len(evidence)),
f AS (SELECT candidate_label, phrase, min((c, i)) AS first FROM x WHERE phrase <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_label ORDER BY first, phrase) AS n FROM f) SELECT candidate_label, string_agg(phrase, '; ' ORDER BY n) AS phrases FROM r WHERE n <= 2 GROUP BY 1""")
def support_phrases(spark, d):
    return reports.support_phrases(decided(spark, d), "candidate_label", [number()])


PERCENT = "printf('%.1f', round(100 * {0}, 1)) || '%'"


@query(f"""WITH {WORK}, {HELD}, {PROGRAM_ROWS}, {DECIDED}, {PHRASES}, a AS (SELECT cluster, label, count(*) AS n FROM clean_rows GROUP BY 1, 2), clean_rows AS (WITH {OBS} SELECT * FROM obs), t AS (SELECT cluster, sum(n) AS t FROM a GROUP BY 1), k AS (SELECT cluster, label, n, n / t AS f, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM a JOIN t USING (cluster)),
comp AS (SELECT cluster, string_agg(label || ' (' || {PERCENT.format('f')} || ', n=' || format('{{:,}}', n) || ')', '; ' ORDER BY k) AS composition FROM k WHERE k <= 5 GROUP BY 1),
h AS (SELECT DISTINCT cluster, upper(gene) AS gene FROM held), hits AS (SELECT cluster, program, string_agg(gene, ',' ORDER BY place) AS genes FROM h JOIN programs USING (gene) GROUP BY 1, 2), ht AS (SELECT cluster, string_agg(program || ': ' || genes, '; ' ORDER BY program) AS program_hits, list(program) AS programs FROM hits GROUP BY 1)
SELECT w.cluster, draft_refined_label AS refined_annotation, candidate_label AS agent_annotation, concat_ws(' | Decision: ', nullif(array_to_string(evidence, '; '), ''), nullif(stop, '')) AS agent_reasoning, n_cells, top_label, {PERCENT.format('top_label_frac')} AS top_label_percent, composition, top_tissue, {PERCENT.format('top_tissue_frac')} AS top_tissue_percent, coalesce(program_hits, '') AS program_hits,
CASE WHEN draft_refined_label = top_label THEN '{vocabulary.QUESTIONS["kept"]}' WHEN draft_refined_label IN {tuple(vocabulary.OTHER_LINEAGES)} THEN '{vocabulary.QUESTIONS["lineage"]}' WHEN list_contains(coalesce(programs, []), 'proliferation') THEN '{vocabulary.QUESTIONS["proliferation"]}' WHEN list_contains(coalesce(programs, []), 'NK tissue/regulatory/chemokine') THEN '{vocabulary.QUESTIONS["tissue"]}' ELSE '{vocabulary.QUESTIONS["refined"]}' END AS validation_question
FROM w LEFT JOIN comp USING (cluster) LEFT JOIN ht USING (cluster) LEFT JOIN norm USING (cluster) LEFT JOIN ph USING (cluster)""".replace("a AS (SELECT cluster, label, count(*) AS n FROM clean_rows GROUP BY 1, 2), clean_rows AS (", "clean_rows AS (").replace("SELECT * FROM obs), t AS (", "SELECT * FROM obs), a AS (SELECT cluster, label, count(*) AS n FROM clean_rows GROUP BY 1, 2), t AS ("))
def validation_table(spark, d):
    """What a colleague checks: worksheet, composition, programs and decision side by side."""
    hits = evidence.program_hits(held(spark, d), "cluster", "gene")
    line = F.struct("program", F.concat("program", F.lit(": "), F.array_join("genes", ",")).alias("t"))
    hits = hits.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "; ").alias("program_hits"), F.collect_list("program").alias("programs"))
    told = decided(spark, d).select("cluster", F.col("candidate_label").alias("agent_annotation"), reports.reasoning(F.col("evidence_summary"), F.col("stop_reason")).alias("agent_reasoning"))
    rows = reports.evidence_table(work(spark, d), compose.composition_lists(obs(spark, d), "cluster", "label"), hits, told)
    question = review.validation_question(F.col("draft_refined_label"), F.col("top_label"), F.coalesce("programs", F.array().cast("array<string>")), F.lit(False))
    return rows.select("cluster", F.col("draft_refined_label").alias("refined_annotation"), "agent_annotation", "agent_reasoning", "n_cells", "top_label", reports.percent_text(F.col("top_label_frac")).alias("top_label_percent"), reports.composition_text(F.col("composition"), 5).alias("composition"), "top_tissue", reports.percent_text(F.col("top_tissue_frac")).alias("top_tissue_percent"), F.coalesce("program_hits", F.lit("")).alias("program_hits"), question.alias("validation_question"))


@query(f"WITH {WORK} SELECT cluster, format('{{:,}}', n_cells) || ' cell' || CASE WHEN n_cells = 1 THEN '' ELSE 's' END AS cells, printf('%.2f', round(top_label_frac, 2)) AS share FROM w")
def shown_numbers(spark, d):
    return work(spark, d).select("cluster", reports.plural(F.col("n_cells"), "cell").alias("cells"), F.format_string("%.2f", F.round("top_label_frac", 2)).alias("share"))


@query()
def prompt_payload(spark, d):
    """Evidence without earlier drafts, as JSON; the two engines write JSON differently."""
    return reports.payload(reports.redacted(work(spark, d)), vocabulary.REFINED_LABELS)


@query(f"WITH {OBS} SELECT cell_id, tissue FROM obs WHERE tissue IN ('lung', 'MACHINERY', 'FURNITURE') AND tissue <> 'FURNITURE'")
def included_rows(spark, d):
    return selection.included(obs(spark, d), "tissue", ["lung", "MACHINERY", "FURNITURE"], ["FURNITURE"]).select("cell_id", "tissue")


@query(f"WITH {OBS}, s AS (SELECT DISTINCT label AS state FROM obs WHERE label <> 'Unknown') SELECT state, state IN (SELECT label FROM obs WHERE nation < 3) AS found FROM s UNION ALL SELECT 'T', false")
def target_states(spark, d):
    o = obs(spark, d)
    known = o.where("nation < 3").select(F.col("label").alias("state"))
    asked = selection.target_states(o, "label", known, asked=["T , T"])
    return selection.target_states(o, "label", known).unionByName(asked)


@query(f"WITH {OBS} SELECT tissue, list_position(['lung', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], tissue) - 1 AS code, count(*) AS n FROM obs GROUP BY 1, 2")
def encoded_categories(spark, d):
    out = selection.encoded(obs(spark, d), "tissue", ["lung", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "code")
    return out.groupBy("tissue", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLEAN}, n AS (SELECT dataset_id, assay_clean, count(*) AS n FROM clean GROUP BY 1, 2) SELECT dataset_id, assay_clean, n, CASE WHEN n < 30 THEN 'too_small' WHEN n < 100 THEN 'small' ELSE 'stable' END AS class, row_number() OVER (ORDER BY n DESC, dataset_id, assay_clean) AS place FROM n")
def batch_profile_bars(spark, d):
    from pyspark.sql import Window

    n = clean(spark, d).groupBy("dataset_id", "assay_clean").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dataset_id", "assay_clean", "n", selection.size_class(F.col("n"), hard=30, warn=100).alias("class"), F.row_number().over(Window.orderBy(F.desc("n"), "dataset_id", "assay_clean")).alias("place"))


@query("WITH " + ev.FEW.split("few AS")[0].replace("50000", "300") + "few AS (SELECT id, z, label, batch FROM (SELECT *, row_number() OVER (ORDER BY md5(id || '|0t'), id) AS q FROM taken) WHERE q <= 300) SELECT id, label, batch, z[1] AS x, z[2] AS y FROM few")
def plot_points(spark, d):
    """What a figure of a map shows: places and labels of a proportional sample."""
    p = ev.sampled_points(spark, d)
    return selection.plot_points(p, "label", "id", 300).select("id", "label", "batch", F.get("z", F.lit(0)).alias("x"), F.get("z", F.lit(1)).alias("y"))


@query(f"WITH {ev.GUESSED}, {ev._classes(src='guessed')}, e AS (SELECT DISTINCT pred AS class FROM guessed WHERE pred NOT IN (SELECT class FROM k)), u AS (SELECT f1, n_true FROM k UNION ALL SELECT 0, 0 FROM e) SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * n_true) / sum(n_true), 9) AS weighted_f1, count(*) AS n_classes, sum(n_true)::BIGINT AS n_rows FROM u")
def unrestricted_f1(spark, d):
    out = bundles.f1_of_all_classes(ev.guessed(spark, d), true="label", predicted="pred")
    return ev.rounded(out, "macro_f1", "weighted_f1")


def _split_sql(name, rows, fewest=20):
    return f"""SELECT '{name}' AS split, * FROM (WITH g AS (SELECT * FROM guessed WHERE {rows} AND label <> 'Unknown'), seen AS (SELECT * FROM g WHERE label <> 'L9'), n AS (SELECT label, count(*) AS n FROM seen GROUP BY 1), kept AS (SELECT * FROM seen WHERE label IN (SELECT label FROM n WHERE n >= {fewest})), {ev._classes()}
SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * n_true) / sum(n_true), 9) AS weighted_f1, sum(n_true)::BIGINT AS n_rows, (SELECT coalesce(string_agg(DISTINCT label, ';' ORDER BY label), '') FROM g WHERE label = 'L9') AS dropped_unseen, (SELECT coalesce(string_agg(label, ';' ORDER BY label), '') FROM n WHERE n < {fewest}) AS dropped_rare FROM k)"""


@query(f"WITH {ev.GUESSED} " + " UNION ALL ".join([_split_sql("val", "batch = 'b0'"), _split_sql("zeroshot", "batch = 'b1'"), _split_sql("full", "true")]))
def split_evaluation(spark, d):
    g = ev.guessed(spark, d)
    splits = {"val": F.col("batch") == "b0", "zeroshot": F.col("batch") == "b1", "full": F.lit(True)}
    out = bundles.split_summary(g, splits, true="label", predicted="pred", training=g.where("label <> 'L9'"), fewest=20)
    return ev.rounded(out, "macro_f1", "weighted_f1")


@query()
def integration_bundle(spark, d):
    """Its parts have SQL of their own, but for communities."""
    return bundles.integration_metrics(ev.sampled_points(spark, d), "latent", label="label", batch="batch", k=10)


@query()
def strategy_bundle(spark, d):
    """Its parts have SQL of their own."""
    p = ev.sampled_points(spark, d).withColumn("assay", F.concat(F.lit("a"), (F.col("id") % 5).cast("string")))
    return bundles.strategy_metrics(p, label="label", batches={"dataset": "batch", "assay": "assay"}, k=10)


@query(f"WITH {SPLIT} SELECT cell_id, label, split FROM split WHERE split = 'Val' AND cell_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND cell_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def keys_in_all(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "cell_id")
    s = split(spark, d).where("split = 'Val'")
    return selection.in_all("cell_id", s, o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'")).select("cell_id", "label", "split")


@query(f"WITH {ev.GUESSED} SELECT e.vec_id, pred, round(confidence, 9) AS confidence FROM embeddings e LEFT JOIN (SELECT * FROM guessed WHERE label <> 'Unknown') g USING (vec_id)")
def cells_with_predictions(spark, d):
    cells = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    g = ev.guessed(spark, d).where("label <> 'Unknown'").select("vec_id", "pred", "confidence")
    return ev.rounded(selection.with_predictions(cells, g, "vec_id"), "confidence")


@query(f"WITH {MERGED} SELECT assay_merged, assay_clean AS assay_merged_original, 'rare assays merged' AS assay_merged_source, count(*) AS n FROM merged GROUP BY 1, 2")
def provenance_columns(spark, d):
    m = merged(spark, d).withColumn("kept_", F.col("assay_clean"))
    tagged = selection.provenance(m, "assay_merged", "rare assays merged").withColumn("assay_merged_original", F.col("kept_"))
    return tagged.groupBy("assay_merged", "assay_merged_original", "assay_merged_source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS clean FROM part")
def clean_scalars(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    odd = F.when(F.col("p_size") % 10 == 0, F.lit(float("nan"))).when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    return p.select("p_partkey", selection.clean_scalar(odd).alias("clean"))


@query(f"WITH {OBS}, w AS (SELECT label, count(*) AS n_cells FROM obs GROUP BY 1), v AS (SELECT *, least(greatest(1.0::DOUBLE / (n_cells + 1e-8::DOUBLE), 0.0001::DOUBLE), 10::DOUBLE) AS r FROM w) SELECT label, round(r / (avg(r) OVER () + 1e-8), 9) AS weight FROM v")
def inverse_frequency_weights(spark, d):
    return recode.class_summary(obs(spark, d), "label", mode="inv_freq", low=0.0001).select("label", F.round("weight", 9).alias("weight"))


def _round_sql(n, before):
    """Decisions on what is left before a round, and the evidence of those that go on."""
    return f"""d{n} AS (SELECT *, list_contains({KNOWN}, draft) AS ok, greatest(0, least(5, round_even(5 * share, 0)))::INT AS c, CASE WHEN share < 0.5 THEN 2 ELSE 0 END AS t FROM {before}),
r{n} AS (SELECT *, CASE WHEN ok AND c >= 4 AND t < 2 THEN 'locked' WHEN ok AND c >= 3 AND t < 2 THEN 'low_priority_review' ELSE 'active_review' END AS review_status FROM d{n}),
e{n} AS (SELECT cluster, draft, round(least(1.0::DOUBLE, share + coalesce((SELECT sum(support) FROM res WHERE res.cluster = r{n}.cluster AND place >= n_pairs AND place < n_pairs + 2), 0)), 9) AS share, n_pairs + (SELECT count(*) FROM res WHERE res.cluster = r{n}.cluster AND place >= n_pairs AND place < n_pairs + 2) AS n_pairs FROM r{n} WHERE review_status <> 'locked')"""


@query(f"""WITH {WORK}, res AS (SELECT (p_partkey % 25)::VARCHAR AS cluster, p_partkey // 25 AS place, (p_size % 10)::DOUBLE / 20 AS support FROM part), e0 AS (SELECT cluster, draft_refined_label AS draft, round(top_label_frac, 9) AS share, 0 AS n_pairs FROM w),
{_round_sql(1, 'e0')}, {_round_sql(2, 'e1')}, {_round_sql(3, 'e2')}, u AS (SELECT *, 1 AS round FROM r1 WHERE review_status = 'locked' UNION ALL SELECT *, 2 FROM r2 WHERE review_status = 'locked' UNION ALL SELECT *, 3 FROM r3)
SELECT cluster, CASE WHEN ok THEN draft ELSE 'Mature Cytotoxic' END AS candidate_label, c AS confidence_score, n_pairs::BIGINT AS n_pairs, review_status, round FROM u""")
def refinement_rounds(spark, d):
    """Groups that are not locked get the results of two more pairs each round, which change their evidence."""
    k = F.col("p_partkey")
    results = spark.read.parquet(f"{d}/part.parquet").select((k % 25).cast("string").alias("cluster"), F.floor(k / 25).alias("place"), ((F.col("p_size") % 10).cast("double") / 20).alias("support"))
    start = work(spark, d).select("cluster", F.col("draft_refined_label").alias("draft"), F.round("top_label_frac", 9).alias("share"), F.lit(0).cast("long").alias("n_pairs"))
    out = review.decided(start, rounds=3, gather=lambda e: review.with_pair_evidence(e, results).withColumn("share", F.round("share", 9)))
    return out.select("cluster", "candidate_label", "confidence_score", "n_pairs", "review_status", "round")
