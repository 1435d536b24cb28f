"""Tables and texts that tell a reviewer what was decided on each group, and why."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import review


def evidence_table(worksheet: DataFrame, *others: DataFrame, key: str = "cluster") -> DataFrame:
    """One row for each group of the worksheet with the columns of all other tables (a row for each group at most, or none), left-joined by key."""
    return reduce(lambda out, other: out.join(other, key, "left"), others, worksheet)


def distance_lookup(novelty: DataFrame, *, key: str = "cluster") -> DataFrame:
    """(key, possible_novel_subtype, novelty_score, nearest_cluster, nearest_distance): the first row of each group, NaN as no number."""
    number = F.when(~F.isnan("nearest_distance"), F.col("nearest_distance"))
    one = F.struct("nearest_distance", "nearest_cluster", "possible_novel_subtype", "novelty_score", number.alias("number"))
    first = novelty.groupBy(key).agg(F.min(one).alias("row_"))
    return first.select(key, "row_.possible_novel_subtype", "row_.novelty_score", "row_.nearest_cluster", F.col("row_.number").alias("nearest_distance"))


def novelty_reason(same_label: Column, isolated: Column, nearest: Column) -> Column:
    return F.concat_ws("; ", F.when(same_label, F.lit("far from a cluster of the same label")), F.when(isolated, F.concat(F.lit("isolated; nearest is "), nearest)))


def mapping_table(decisions: DataFrame, evidence: DataFrame, *, key: str = "cluster", threshold: int = 4) -> DataFrame:
    """The final decision on each group with what it rests on, 20 columns.

    decisions has the fields of review.normalised() and n_iterations; evidence has n_cells, top_label, top_label_frac, top_tissue, draft_refined_label,
    note, n_pairs, possible_novel_subtype, novelty_score and novel_subtype_reason, each null where there is none.
    """
    rows = decisions.join(evidence, key, "left")
    c = F.col
    flags = (c("needs_human_review"), c("confidence_score"), c("technical_concern_score"), c("suggested_new_label"))
    pairs = F.coalesce("n_pairs", F.lit(0))
    return rows.select(
        key,
        c("candidate_label").alias("candidate_refined_label"),
        review.needs_review(*flags, threshold).alias("needs_human_review"),
        review.review_reason(flags[0], flags[1], c("ambiguity_score"), flags[2], flags[3], F.coalesce("note", F.lit("")), pairs, threshold).alias("review_reason"),
        "n_cells",
        c("top_label").alias("top_original_label"),
        c("top_label_frac").alias("top_original_label_frac"),
        c("confidence_score").alias("confidence_score_0_5"),
        c("ambiguity_score").alias("ambiguity_score_0_5"),
        c("technical_concern_score").alias("technical_concern_score_0_5"),
        "top_tissue",
        c("draft_refined_label").alias("worksheet_initial_draft_label"),
        "n_iterations",
        pairs.alias("n_pairwise_DE_compared"),
        F.coalesce("possible_novel_subtype", F.lit(False)).alias("possible_novel_subtype"),
        F.coalesce("novelty_score", F.lit(0)).alias("novel_subtype_score_0_5"),
        F.coalesce("novel_subtype_reason", F.lit("")).alias("novel_subtype_reason"),
        F.coalesce(F.nullif("suggested_new_label", F.lit("")), F.lit("None")).alias("alternative_name_suggestion"),
        review.alternative_reason(c("suggested_new_label"), c("new_label_reason")).alias("alternative_name_reason"),
        F.array_join("recommended_pairwise_comparisons", "; ").alias("recommended_pairwise_comparisons"),
    )


def reasoning(evidence: Column, stop: Column) -> Column:
    """Evidence phrases joined by '; ', then the decision's own words."""
    return F.concat_ws(" | Decision: ", F.nullif(F.array_join(evidence, "; "), F.lit("")), F.nullif(F.trim(stop), F.lit("")))


def percent_text(share: Column, digits: int = 1) -> Column:
    """A share as 12.3%, halves away from zero; '' for none."""
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", F.round(100 * share, digits)), F.lit("%")), F.lit(""))


def whole_text(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n.cast("long"), 0)


def composition_text(composition: Column, first: int) -> Column:
    """label (share, n=count) of the first categories; the label alone where there is no share."""
    one = lambda x: F.concat(x["label"], F.coalesce(F.concat(F.lit(" ("), percent_text(x["fraction"]), F.lit(", n="), whole_text(x["n_cells"]), F.lit(")")), F.lit("")))
    return F.array_join(F.transform(F.slice(composition, 1, first), one), "; ")


def status_table(decisions: DataFrame, *, key: str = "cluster") -> DataFrame:
    """Where each group stands: its label, scores, triage and whether a person is asked."""
    c = F.col
    told = review.triage(c("candidate_label"), c("confidence_score"), c("ambiguity_score"), c("technical_concern_score"), c("needs_human_review"), c("suggested_new_label"))
    return decisions.select(key, "candidate_label", "confidence_score", "ambiguity_score", "technical_concern_score", told.alias("review_status"), "needs_human_review", F.coalesce(F.nullif("suggested_new_label", F.lit("")), F.lit("None")).alias("suggested_new_label"))


def support_phrases(decisions: DataFrame, label: str, order: list[Column], *, phrases: str = "evidence_summary", most: int = 2) -> DataFrame:
    """(label, phrases): the first distinct evidence phrases of each label over its groups in order, without their final dots."""
    rows = decisions.select(label, F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]).alias("at"), F.posexplode(phrases).alias("k", "phrase"))
    first = rows.select(label, "at", "k", F.rtrim(F.trim("phrase"), F.lit(".")).alias("phrase")).where("phrase <> ''").groupBy(label, "phrase").agg(F.min(F.struct("at", "k")).alias("first"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy("first", "phrase"))).where(F.col("n") <= most)
    return ranked.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]), "; ").alias("phrases"))


def alternatives(mapping: DataFrame, order: list[Column], *, key: str = "cluster") -> DataFrame:
    """One row: the groups with another name suggested, as text, in order."""
    some = mapping.where(F.lower("alternative_name_suggestion") != "none")
    at = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    listed = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.concat(F.col(key), F.lit(": "), F.col("alternative_name_suggestion")).alias("t")))), lambda x: x["t"]), "; ").alias("alternatives"))
    return listed.select(F.when(F.col("alternatives") == "", F.lit("none")).otherwise(F.col("alternatives")).alias("alternatives"))


def plural(n: Column, noun: str) -> Column:
    """1 noun, 2 nouns."""
    return F.concat(whole_text(n), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def redacted(evidence: DataFrame, drafts: Sequence[str] = ("draft_refined_label", "review_notes", "review_priority", "worksheet_review_note"), *, related: str | None = None) -> DataFrame:
    """Evidence without what an earlier draft said of the group, or (related: an array of structs) of its neighbours."""
    out = evidence.drop(*drafts)
    return out.withColumn(related, F.transform(related, lambda x: x.dropFields("draft"))) if related else out


def payload(evidence: DataFrame, labels: Sequence[str], *, key: str = "cluster") -> DataFrame:
    """(key, payload): evidence of each group, the labels to choose from and the fields to be answered, as JSON."""
    fields = [*review.TEXTS, *review.SCORES, *review.LISTS, *review.FLAGS]
    body = F.struct(F.struct(*[F.col(c) for c in evidence.columns]).alias("evidence"), F.lit(list(labels)).alias("labels"), F.lit(fields).alias("fields"))
    return evidence.select(key, F.to_json(body).alias("payload"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown text. ValueError beyond most rows: it is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    clean = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([clean(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def report(mapping: DataFrame, kinds: DataFrame, order: list[Column], *, key: str = "cluster", title: str = "Annotation report") -> str:
    """A Markdown report of a mapping_table(): the summary table, which labels were kept, merged and refined (of review.label_kinds()), and a section for each group."""
    shown = mapping.orderBy(*order)
    summary = shown.select(key, "n_cells", "candidate_refined_label", "needs_human_review", "review_reason", "top_original_label", "confidence_score_0_5", "alternative_name_suggestion")
    lines = [f"# {title}", "", "## Summary", "", markdown_table(summary), "", "## Labels", ""]
    told = kinds.collect()  # a row for each label
    for kind in ("kept", "merged", "refined"):
        names = sorted(r.label for r in told if r[kind])
        lines.append(f"- {kind}: {', '.join(names) or 'none'}")
    lines += ["", "## Groups", ""]
    for r in shown.collect():  # as many rows as the summary, which is bounded
        lines += [f"### {r[key]}: {r.candidate_refined_label}", "", f"- Confidence {r.confidence_score_0_5} of 5, ambiguity {r.ambiguity_score_0_5}, technical concern {r.technical_concern_score_0_5}", f"- {r.review_reason}", f"- Original label: {r.top_original_label}", f"- Other name: {r.alternative_name_suggestion}. {r.alternative_name_reason}", ""]
    return "\n".join(lines)
