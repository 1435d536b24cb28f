"""Queries: programs, related groups, labels and notes in text, decisions, triage, review reasons, pair queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compose, evidence, review, vocabulary
from .composition import WORKSHEET, clean
from .registry import query


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


KNOWN = _list(vocabulary.REFINED_LABELS)
ALL_GENES = [g for gs in vocabulary.PROGRAMS.values() for g in gs]

#: Genes of groups, made from the vocabulary by a rule on part keys; every fifth is in lower case.
HELD = f"""held AS (SELECT DISTINCT (p_partkey % 7)::VARCHAR AS cluster, CASE WHEN p_partkey % 5 = 0 THEN lower(g) ELSE g END AS gene, p_partkey % 11 AS place
  FROM (SELECT p_partkey, {_list(ALL_GENES)}[(p_partkey * 31 % {len(ALL_GENES)} + 1)::INT] AS g FROM part))"""


def held(spark, d):
    k = F.col("p_partkey")
    g = F.get(F.lit(ALL_GENES), (k * 31 % len(ALL_GENES)).cast("int"))
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select((k % 7).cast("string").alias("cluster"), F.when(k % 5 == 0, F.lower(g)).otherwise(g).alias("gene"), (k % 11).alias("place")).distinct()


PROGRAM_ROWS = "programs AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {k}, '{g}')" for p, gs in vocabulary.PROGRAMS.items() for k, g in enumerate(gs)) + ") t(program, place, gene))"


@query(f"WITH {HELD}, {PROGRAM_ROWS}, h AS (SELECT DISTINCT cluster, upper(gene) AS gene FROM held) SELECT cluster, program, string_agg(gene, ',' ORDER BY place) AS genes FROM h JOIN programs USING (gene) GROUP BY 1, 2")
def program_hits(spark, d):
    return evidence.program_hits(held(spark, d), "cluster", "gene").withColumn("genes", F.array_join("genes", ","))


@query(f"""WITH {HELD}, g AS (SELECT cluster, list(gene ORDER BY place, gene)[1:25] AS genes FROM held GROUP BY 1), u AS (SELECT cluster, CASE WHEN cluster = '6' THEN NULL WHEN cluster IN ('1', '4') THEN 'T' ELSE 'N' || cluster END AS label, CASE WHEN cluster IN ('2', '3') THEN NULL ELSE 'x' || cluster END AS draft, list_distinct(list_transform(genes, lambda x: upper(x))) AS genes FROM g),
p AS (SELECT a.cluster, b.cluster AS other, (a.label IS NOT DISTINCT FROM b.label)::INT AS sl, (a.draft IS NOT DISTINCT FROM b.draft)::INT AS sd, len(list_intersect(a.genes, b.genes)) AS c FROM u a JOIN u b ON a.cluster <> b.cluster),
s AS (SELECT cluster, other, round(sl + sd + c / 10.0::DOUBLE, 6) AS score FROM p WHERE sl = 1 OR sd = 1 OR c >= 3) SELECT cluster, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, other DESC) AS rank FROM s) WHERE rank <= 4""")
def related_clusters(spark, d):
    g = held(spark, d).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gene"))), lambda x: x["gene"]).alias("genes"))
    c = F.col("cluster")
    g = g.withColumns({"label": F.when(c == "6", None).when(c.isin("1", "4"), F.lit("T")).otherwise(F.concat(F.lit("N"), c)), "draft": F.when(c.isin("2", "3"), None).otherwise(F.concat(F.lit("x"), c))})
    return evidence.related_groups(g, most=4).withColumn("score", F.round("score", 6))


@query(f"WITH {HELD}, n AS (SELECT cluster, upper(gene) AS gene, min(place) AS p FROM held GROUP BY 1, 2) SELECT gene, min(p) AS place FROM n GROUP BY 1")
def ordered_gene_union(spark, d):
    return evidence.ordered_union(held(spark, d).withColumn("gene", F.upper("gene")), "gene", F.col("place"))


RAW = ["Mature Cytotoxic review", "mature cytotoxic tcf7+ low", "Cytokine-Stimulated review: split effector vs CCR7+", " T ", "Transitional Cytotoxic Tissue-Resident review", "Transitional Cytotoxic odd one", "something else", "B cells review"]
RAW_SQL = f"raw AS (SELECT DISTINCT CASE WHEN p_partkey % 9 = 8 THEN p_name ELSE {_list(RAW)}[(p_partkey % 9 + 1)::INT] END AS raw FROM part)"


def raw(spark, d):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(F.when(k % 9 == 8, F.col("p_name")).otherwise(F.get(F.lit(RAW), (k % 9).cast("int"))).alias("raw")).distinct()


@query(f"""WITH {RAW_SQL}, t AS (SELECT raw, trim(raw) AS t, instr(lower(trim(raw)), ' review:') AS cut FROM raw), b AS (SELECT *, ends_with(lower(t), ' review') AS e, CASE WHEN ends_with(lower(t), ' review') THEN trim(t[:length(t) - 7]) ELSE t END AS body FROM t),
k AS (SELECT raw, arg_max(name, length(name)) AS name FROM b, (SELECT unnest({KNOWN}) AS name) WHERE lower(body) = lower(name) OR starts_with(lower(body), lower(name) || ' ') GROUP BY 1),
s AS (SELECT b.*, coalesce(name, body) AS l, CASE WHEN name IS NULL OR lower(body) = lower(name) THEN '' ELSE trim(body[length(name) + 1:]) END AS n FROM b LEFT JOIN k USING (raw))
SELECT raw, CASE WHEN cut > 0 THEN trim(t[:cut - 1]) ELSE l END AS label, CASE WHEN cut > 0 THEN trim(t[cut + 8:]) WHEN e THEN CASE WHEN n = '' THEN 'review' ELSE n || '; review' END ELSE n END AS note FROM s""")
def draft_label_split(spark, d):
    label, note = text.split_draft_label(F.col("raw"), vocabulary.REFINED_LABELS)
    return raw(spark, d).select("raw", label.alias("label"), note.alias("note"))


@query("""WITH n AS (SELECT DISTINCT o_orderpriority || '; ' || o_orderstatus || ';;' || o_orderpriority AS a, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'nan' ELSE ' x ;' || o_orderstatus END AS b FROM orders)
SELECT a, b, split_part(a, ';', 1) || '; ' || trim(split_part(a, ';', 2)) || CASE WHEN b IS NULL OR b = 'nan' THEN '' ELSE '; x' END AS note FROM n""")
def note_combine(spark, d):
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    n = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(p, F.lit("; "), s, F.lit(";;"), p).alias("a"), F.when(k % 3 == 0, None).when(k % 3 == 1, F.lit("nan")).otherwise(F.concat(F.lit(" x ;"), s)).alias("b")).distinct()
    return n.select("a", "b", text.combine_notes(F.col("a"), F.col("b")).alias("note"))


@query(f"""WITH w AS ({WORKSHEET}) SELECT cluster, review_notes, list_aggregate(list_transform(list_filter(string_split(review_notes, ';'), lambda x: x <> ''), lambda x: CASE x WHEN 'mixed_original_NK_State' THEN 'mixed original manual labels' WHEN 'high_tissue_specificity' THEN 'mostly from one tissue' WHEN 'high_assay_specificity' THEN 'mostly from one assay' WHEN 'high_dataset_specificity' THEN 'mostly from one dataset' ELSE x END), 'string_agg', '; ') AS shown FROM w""")
def note_words(spark, d):
    w = compose.worksheet(clean(spark, d), "cluster", label="label", tissue="tissue", assay="assay_clean", dataset="dataset_id")
    return w.select("cluster", "review_notes", text.humanise(F.col("review_notes"), vocabulary.NOTE_WORDS).alias("shown"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 30)::VARCHAR ELSE 'compare ' || event_id % 25 || ' with ' || event_id % 40 || ', then ' || event_id % 25 || ' (v2)' END AS t FROM events),
f AS (SELECT event_id, t, list_filter(regexp_extract_all(t, '\\b(\\d+)\\b', 1), lambda x: x::INT < 25) AS ids FROM t)
SELECT event_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_position(ids, ids[i]) = i THEN ids[i] END), ',') AS ids FROM f""")
def extract_ids(spark, d):
    k = F.col("event_id")
    s = lambda n: (k % n).cast("string")
    t = F.when(k % 4 == 0, s(30)).otherwise(F.concat(F.lit("compare "), s(25), F.lit(" with "), s(40), F.lit(", then "), s(25), F.lit(" (v2)")))
    valid = F.lit([str(i) for i in range(25)])
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(text.ids_in(t, valid), ",").alias("ids"))


@query("""SELECT DISTINCT replace(p_name, ' ', ' + ') || ' /x' AS name, trim(regexp_replace(replace(translate(replace(p_name, ' ', ' + ') || ' /x', ' /\\:|', '_____'), '+', 'plus'), '_+', '_', 'g'), '_') AS safe FROM part""")
def safe_names(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(" + ")), F.lit(" /x")).alias("name")).distinct()
    return n.select("name", text.safe_name(F.col("name")).alias("safe"))


#: Decisions as text: clean, wrapped in prose, a text for a list, scores out of range or in words, unknown labels, no object at all.
KINDS = [
    '{"candidate_label": "T", "confidence_score": 4.5, "ambiguity_score": 1, "technical_concern_score": 0, "alternate_labels": ["B", "Odd"], "needs_human_review": false}',
    'Here it is: {"candidate_label": "Mature Cytotoxic", "confidence_score": "9", "ambiguity_score": 2.5, "evidence_summary": "strong NKG7", "needs_more_iteration": true} Done.',
    '{"candidate_label": "Strange NK", "confidence_score": "high", "concerns": ["looks Proliferative"], "technical_concern_score": -3}',
    '{"candidate_label": "Unseen", "alternate_labels": ["Regulatory"], "suggested_new_label": "Fresh", "new_label_reason": "why not", "confidence_score": 3}',
    "no object here",
    '{"cluster_id": "77", "candidate_label": "", "evidence_summary": ["nothing"], "recommended_pairwise_comparisons": ["3 vs 12", "all"]}',
]
DECISIONS = f"""dec AS (SELECT p_partkey AS cluster, {_list(KINDS)}[(p_partkey % 6 + 1)::INT] AS decision FROM part),
m AS (SELECT cluster, try_cast(nullif(regexp_extract(decision, '(?s)\\{{.*\\}}', 0), '') AS JSON) AS j FROM dec),
sc AS (SELECT cluster, {', '.join(f"CASE WHEN try_cast(j->>'{s}' AS DOUBLE) IS NULL THEN 0 ELSE greatest(0, least(5, round_even(try_cast(j->>'{s}' AS DOUBLE), 0)))::INT END AS {s}" for s in review.SCORES)},
 trim(coalesce(j->>'candidate_label', '')) AS said, trim(coalesce(j->>'suggested_new_label', '')) AS sug, trim(coalesce(j->>'new_label_reason', '')) AS why,
 coalesce(nullif(trim(coalesce(j->>'cluster_id', '')), ''), cluster::VARCHAR) AS cluster_id, lower(coalesce(j->>'needs_human_review', '')) = 'true' AS nr, lower(coalesce(j->>'needs_more_iteration', '')) = 'true' AS nm,
 list_filter(coalesce(try_cast(j->'alternate_labels' AS VARCHAR[]), []), lambda x: list_contains({KNOWN}, x)) AS alt,
 lower(concat_ws(' ', coalesce(j->>'candidate_label', ''), CASE WHEN json_type(j->'evidence_summary') = 'VARCHAR' THEN j->>'evidence_summary' ELSE array_to_string(coalesce(try_cast(j->'evidence_summary' AS VARCHAR[]), []), ' ') END, array_to_string(coalesce(try_cast(j->'concerns' AS VARCHAR[]), []), ' '))) AS blob,
 CASE WHEN json_type(j->'evidence_summary') = 'VARCHAR' THEN 1 ELSE len(coalesce(try_cast(j->'evidence_summary' AS VARCHAR[]), [])) END AS ne, len(coalesce(try_cast(j->'concerns' AS VARCHAR[]), [])) AS nc FROM m),
un AS (SELECT *, NOT list_contains({KNOWN}, said) AS un, list_filter({KNOWN}, lambda x: contains(blob, lower(x)))[1] AS ment FROM sc),
norm AS (SELECT cluster, cluster_id, CASE WHEN un THEN coalesce(alt[1], ment, 'Mature Cytotoxic') ELSE said END AS candidate_label, CASE WHEN un AND said <> '' AND sug = '' THEN said ELSE sug END AS suggested_new_label,
 CASE WHEN un AND said <> '' AND sug = '' AND why = '' THEN '{vocabulary.PROPOSED}' ELSE why END AS new_label_reason, {', '.join(review.SCORES)}, nm AS needs_more_iteration, nr OR (CASE WHEN un AND said <> '' AND sug = '' THEN said ELSE sug END) <> '' AS needs_human_review, array_to_string(alt, '|') AS alternates, ne AS n_evidence, nc + un::INT AS n_concerns FROM un)"""


def decisions(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(k.alias("cluster"), F.get(F.lit(KINDS), (k % 6).cast("int")).alias("decision"))
    return review.normalised(rows)


@query(f"WITH {DECISIONS} SELECT cluster, cluster_id, candidate_label, suggested_new_label, new_label_reason, {', '.join(review.SCORES)}, needs_more_iteration, needs_human_review, alternates, n_evidence, n_concerns FROM norm")
def json_decision_normalise(spark, d):
    out = decisions(spark, d)
    return out.select("cluster", "cluster_id", "candidate_label", "suggested_new_label", "new_label_reason", *review.SCORES, *review.FLAGS, F.array_join("alternate_labels", "|").alias("alternates"), F.size("evidence_summary").alias("n_evidence"), F.size("concerns").alias("n_concerns"))


TRIAGE = f"CASE WHEN list_contains({KNOWN}, candidate_label) AND ambiguity_score <= 2 AND technical_concern_score < 2 AND suggested_new_label = '' AND confidence_score >= 4 AND NOT needs_human_review THEN 'locked' WHEN list_contains({KNOWN}, candidate_label) AND ambiguity_score <= 2 AND technical_concern_score < 2 AND suggested_new_label = '' AND confidence_score >= 3 THEN 'low_priority_review' ELSE 'active_review' END"


@query(f"WITH {DECISIONS} SELECT cluster, {TRIAGE} AS review_status, (needs_more_iteration OR (needs_human_review AND 1 < 2)) AND 1 <= 5 AS goes_on FROM norm")
def triage(spark, d):
    out = decisions(spark, d)
    return out.select("cluster", review.triage(F.col("candidate_label"), F.col("confidence_score"), F.col("ambiguity_score"), F.col("technical_concern_score"), F.col("needs_human_review"), F.col("suggested_new_label")).alias("review_status"), review.goes_on(F.col("needs_more_iteration"), F.col("needs_human_review"), F.lit(1), F.lit(1)).alias("goes_on"))


@query(f"""WITH {DECISIONS}, r AS (SELECT *, needs_human_review OR confidence_score < 4 OR technical_concern_score >= 2 OR suggested_new_label <> '' AS need, cluster % 3 AS np, CASE WHEN cluster % 4 = 0 THEN 'mostly from one assay; odd' END AS note FROM norm),
s AS (SELECT *, concat_ws('; ', CASE WHEN confidence_score < 4 THEN 'confidence ' || confidence_score || '<4' END, CASE WHEN technical_concern_score >= 2 THEN 'technical concern ' || technical_concern_score || '/5' END, CASE WHEN suggested_new_label <> '' THEN 'suggested new label: ' || suggested_new_label END, note) AS ask,
concat_ws('; ', 'confident approved label (' || confidence_score || '/5)', CASE WHEN ambiguity_score <= 2 THEN 'low ambiguity (' || ambiguity_score || '/5)' END, CASE WHEN technical_concern_score < 2 THEN 'low technical concern (' || technical_concern_score || '/5)' END, CASE WHEN np > 0 THEN 'reviewed ' || np || ' pairwise DE comparison(s)' END) AS fine FROM r)
SELECT cluster, need AS needs_human_review, CASE WHEN NOT need THEN fine WHEN ask = '' AND needs_human_review THEN 'model uncertainty' ELSE ask END AS review_reason,
CASE WHEN new_label_reason <> '' THEN new_label_reason WHEN suggested_new_label <> '' THEN '{vocabulary.OTHER_NAME}' ELSE '{vocabulary.NO_OTHER_NAME}' END AS alternative_name_reason FROM s""")
def mapping_review(spark, d):
    out = decisions(spark, d)
    k = F.col("cluster")
    c = [F.col(n) for n in ("needs_human_review", "confidence_score", "technical_concern_score", "suggested_new_label")]
    note = F.when(k % 4 == 0, F.lit("high_assay_specificity;odd")).otherwise(F.lit(""))
    reason = review.review_reason(c[0], c[1], F.col("ambiguity_score"), c[2], c[3], note, k % 3)
    return out.select("cluster", review.needs_review(*c).alias("needs_human_review"), reason.alias("review_reason"), review.alternative_reason(c[3], F.col("new_label_reason")).alias("alternative_name_reason"))


@query("""WITH r AS (SELECT o_orderstatus || '; ' || o_orderpriority || ' ;' AS r FROM orders), p AS (SELECT trim(unnest(string_split(r, ';'))) AS reason FROM r) SELECT reason, count(*) AS n FROM p WHERE reason <> '' GROUP BY 1""")
def review_reason_counts(spark, d):
    r = spark.read.parquet(f"{d}/orders.parquet").select(F.concat("o_orderstatus", F.lit("; "), "o_orderpriority", F.lit(" ;")).alias("r"))
    return review.reason_counts(r, "r")


@query("""WITH q AS (SELECT 0 AS queue, o_orderkey AS place, o_orderkey % 25 AS a, o_custkey % 25 AS b FROM orders UNION ALL SELECT 1, p_partkey, p_size % 25, p_partkey % 25 FROM part),
n AS (SELECT least(a, b)::INT AS cluster_a, greatest(a, b)::INT AS cluster_b, min((queue, place)) AS met FROM q WHERE a <> b GROUP BY 1, 2) SELECT cluster_a, cluster_b, place FROM (SELECT cluster_a, cluster_b, row_number() OVER (ORDER BY met) AS place FROM n) WHERE place <= 60""")
def queue_merge(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 25).alias("a"), (F.col("o_custkey") % 25).alias("b"), F.col("o_orderkey").alias("place"))
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") % 25).alias("a"), (F.col("p_partkey") % 25).alias("b"), F.col("p_partkey").alias("place"))
    return review.merged_queue([x.where("a <> b") for x in (o, p)], 60)


LABELLED = f"lab AS (SELECT p_partkey AS cluster, {KNOWN}[(p_size % 15 + 1)::INT] AS label, {KNOWN}[(p_partkey % 15 + 1)::INT] AS original FROM part)"


def labelled(spark, d):
    known = F.lit(vocabulary.REFINED_LABELS)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("cluster"), F.get(known, F.col("p_size") % 15).alias("label"), F.get(known, (F.col("p_partkey") % 15).cast("int")).alias("original"))


@query(f"WITH {LABELLED} SELECT label, count(DISTINCT cluster) AS n_clusters, count(DISTINCT original) AS n_originals, bool_or(label = original) AS kept, bool_or(label <> original) AS refined, count(DISTINCT cluster) >= 2 AND (count(DISTINCT original) >= 2 OR count(DISTINCT cluster) >= 3) AS merged FROM lab GROUP BY 1")
def label_kinds(spark, d):
    return review.label_kinds(labelled(spark, d), "cluster", "label", "original")


@query(f"WITH {LABELLED} SELECT bool_or(contains(label, 'Cytotoxic')) AS cytotoxic, bool_or(contains(label, 'Tissue-Resident') OR starts_with(label, 'Lung')) AS tissue, bool_or(contains(label, 'Cytokine-Stimulated')) AS cytokine, bool_or(contains(label, 'Proliferative')) AS proliferative, bool_or(label IN ('T', 'B', 'Myeloid-like', 'Unknown_BM_1 Erythroid-like')) AS other_lineages FROM lab")
def lineage_themes(spark, d):
    return review.lineage_themes(labelled(spark, d), "label")


@query(f"""WITH {LABELLED} SELECT cluster, CASE WHEN label = original THEN '{vocabulary.QUESTIONS["kept"]}' WHEN label IN {tuple(vocabulary.OTHER_LINEAGES)} THEN '{vocabulary.QUESTIONS["lineage"]}'
WHEN cluster % 4 = 0 THEN '{vocabulary.QUESTIONS["proliferation"]}' WHEN cluster % 4 = 1 THEN '{vocabulary.QUESTIONS["tissue"]}' WHEN cluster % 4 = 2 THEN '{vocabulary.QUESTIONS["flags"]}' ELSE '{vocabulary.QUESTIONS["refined"]}' END AS question FROM lab""")
def validation_questions(spark, d):
    k = F.col("cluster")
    programs = F.when(k % 4 == 0, F.array(F.lit("proliferation"))).when(k % 4 == 1, F.array(F.lit("NK tissue/regulatory/chemokine"))).otherwise(F.array(F.lit("B cell")))
    means = F.when(k % 4 == 2, F.create_map(F.lit("CD3E"), F.lit(1.5))).otherwise(F.create_map(F.lit("CD3E"), F.lit(0.5)))
    return labelled(spark, d).select("cluster", review.validation_question(F.col("label"), F.col("original"), programs, evidence.high_other_lineage(means)).alias("question"))


@query(f"""WITH w AS ({WORKSHEET}), e AS (SELECT cluster, draft_refined_label AS draft, top_label_frac AS share FROM w), r AS (SELECT cluster, draft, share, list_contains({KNOWN}, draft) AS ok, greatest(0, least(5, round_even(5 * share, 0)))::INT AS c FROM e),
x AS (SELECT *, CASE WHEN share < 0.5 THEN 2 ELSE 0 END AS t FROM r)
SELECT cluster, CASE WHEN ok THEN draft ELSE 'Mature Cytotoxic' END AS candidate_label, c AS confidence_score, CASE WHEN ok AND c >= 4 AND 5 - c <= 2 AND t < 2 THEN 'locked' WHEN ok AND c >= 3 AND 5 - c <= 2 AND t < 2 THEN 'low_priority_review' ELSE 'active_review' END AS review_status, CASE WHEN ok AND c >= 4 AND t < 2 THEN 1 ELSE 3 END AS round FROM x""")
def agent_rounds(spark, d):
    """The decision loop with the offline, rule-based decision maker."""
    w = compose.worksheet(clean(spark, d), "cluster", label="label", tissue="tissue", assay="assay_clean", dataset="dataset_id")
    e = w.select("cluster", F.col("draft_refined_label").alias("draft"), F.col("top_label_frac").alias("share"))
    return review.decided(e, rounds=3).select("cluster", "candidate_label", "confidence_score", "review_status", "round")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def windowed_event_counts(spark, d):
    """An extension: the stream operator over a table."""
    from ..streaming import windowed_counts

    return windowed_counts(spark.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 6))
