"""Decisions on groups: parsing, normalising, triage, review reasons, pair queues, and an offline decision maker."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import score_0_to_5
from ..functions.text import combine_notes, humanise, ids_in
from ..scratch import Scratch
from . import vocabulary

SCORES = ("confidence_score", "manual_annotation_support", "top_de_marker_support", "curated_marker_support", "technical_concern_score", "ambiguity_score")
LISTS = ("alternate_labels", "evidence_summary", "concerns", "recommended_pairwise_comparisons")
TEXTS = ("cluster_id", "candidate_label", "suggested_new_label", "new_label_reason", "stop_reason")
FLAGS = ("needs_more_iteration", "needs_human_review")

def parsed(text: Column) -> Column:
    """The object in a text: from the first brace to the last. A map of its fields as JSON text."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "map<string,string>")


def _list(field: Column) -> Column:
    """A JSON list as an array of texts; a text alone is a list of one."""
    whole = F.from_json(field, "array<string>")
    return F.when(field.isNull(), F.array().cast("array<string>")).when(F.trim(field).startswith("["), F.coalesce(whole, F.array().cast("array<string>"))).otherwise(F.array(field))


def normalised(decisions: DataFrame, *, text: str = "decision", cluster: str = "cluster", audit: str | None = None, known: Sequence[str] = vocabulary.REFINED_LABELS, fallback: str = "Mature Cytotoxic") -> DataFrame:
    """Decisions with typed fields: scores within 0 and 5, lists, texts, flags, and a candidate label that is known.

    A label that is not known moves to suggested_new_label, and the first known alternate,
    else the first known label that the texts mention, else fallback, takes its
    place.  A new label asks for review.  audit names a flag: with it, a decision
    without a new label says why.
    """
    out = decisions.withColumn("m_", parsed(F.col(text)))
    get = lambda k: F.try_element_at(F.col("m_"), F.lit(k))
    words = lambda k: F.trim(F.coalesce(get(k), F.lit("")))
    out = out.withColumns({s: score_0_to_5(get(s)) for s in SCORES} | {k: _list(get(k)) for k in LISTS} | {k: words(k) for k in TEXTS} | {f: F.lower(words(f)).isin("true", "1") for f in FLAGS})
    known_list = F.lit(list(known))
    out = out.withColumn("cluster_id", F.when(F.col("cluster_id") == "", F.col(cluster).cast("string")).otherwise(F.col("cluster_id")))
    mentions = F.lower(F.concat_ws(" ", F.col("candidate_label"), F.concat_ws(" ", "evidence_summary"), F.concat_ws(" ", "concerns")))
    mentioned = F.get(F.filter(known_list, lambda k: F.contains(mentions, F.lower(k))), F.lit(0))
    unknown = ~F.array_contains(known_list, F.col("candidate_label"))
    out = out.withColumns({"unknown_": unknown, "said_": F.col("candidate_label"), "alternate_labels": F.filter("alternate_labels", lambda a: F.array_contains(known_list, a)), "mentioned_": mentioned})
    moved = F.col("unknown_") & (F.col("said_") != "") & (F.col("suggested_new_label") == "")
    out = out.withColumns({"new_label_reason": F.when(moved & (F.col("new_label_reason") == ""), F.lit(vocabulary.PROPOSED)).otherwise(F.col("new_label_reason")), "suggested_new_label": F.when(moved, F.col("said_")).otherwise(F.col("suggested_new_label"))})
    out = out.withColumns(
        {
            "candidate_label": F.when(F.col("unknown_"), F.coalesce(F.get("alternate_labels", F.lit(0)), "mentioned_", F.lit(fallback))).otherwise(F.col("said_")),
            "concerns": F.when(F.col("unknown_"), F.concat("concerns", F.array(F.lit(vocabulary.MOVED)))).otherwise(F.col("concerns")),
            "needs_human_review": F.col("needs_human_review") | (F.col("suggested_new_label") != ""),
        }
    )
    if audit:
        out = out.withColumn("new_label_reason", F.when(F.col(audit) & (F.col("suggested_new_label") == "") & (F.col("new_label_reason") == ""), F.lit(vocabulary.SUFFICIENT)).otherwise(F.col("new_label_reason")))
    return out.drop("m_", "unknown_", "said_", "mentioned_")


def triage(label: Column, confidence: Column, ambiguity: Column, technical: Column, needs_review: Column, new_label: Column, known: Sequence[str] = vocabulary.REFINED_LABELS) -> Column:
    fine = label.isin(*known) & (ambiguity <= 2) & (technical < 2) & (F.trim(new_label) == "")
    return F.when(fine & (confidence >= 4) & ~needs_review, F.lit("locked")).when(fine & (confidence >= 3), F.lit("low_priority_review")).otherwise(F.lit("active_review"))


def goes_on(wants_more: Column, needs_review: Column, n_decisions: Column, iteration: Column, most: int = 5) -> Column:
    return (wants_more | (needs_review & (n_decisions < 2))) & (iteration <= most)


def needs_review(flag: Column, confidence: Column, technical: Column, new_label: Column, threshold: int = 4) -> Column:
    return flag | (confidence < threshold) | (technical >= 2) | (F.coalesce(new_label, F.lit("")) != "")


def review_reason(flag: Column, confidence: Column, ambiguity: Column, technical: Column, new_label: Column, note: Column, n_pairs: Column, threshold: int = 4) -> Column:
    """Why a decision is to be reviewed, or why not."""
    text = lambda c: c.cast("string")
    shown = F.nullif(humanise(note, vocabulary.NOTE_WORDS), F.lit(""))
    reasons = F.concat_ws("; ", F.when(confidence < threshold, F.concat(F.lit("confidence "), text(confidence), F.lit(f"<{threshold}"))), F.when(technical >= 2, F.concat(F.lit("technical concern "), text(technical), F.lit("/5"))), F.when(F.trim(new_label) != "", F.concat(F.lit("suggested new label: "), F.trim(new_label))), shown)
    fine = F.concat_ws("; ", F.concat(F.lit("confident approved label ("), text(confidence), F.lit("/5)")), F.when(ambiguity <= 2, F.concat(F.lit("low ambiguity ("), text(ambiguity), F.lit("/5)"))), F.when(technical < 2, F.concat(F.lit("low technical concern ("), text(technical), F.lit("/5)"))), F.when(n_pairs > 0, F.concat(F.lit("reviewed "), text(n_pairs), F.lit(" pairwise DE comparison(s)"))))
    asked = F.when((reasons == "") & flag, F.lit("model uncertainty")).otherwise(reasons)
    return F.when(needs_review(flag, confidence, technical, new_label, threshold), asked).otherwise(fine)


def alternative_reason(new_label: Column, reason: Column) -> Column:
    said = F.nullif(F.trim(F.coalesce(reason, F.lit(""))), F.lit(""))
    new = F.trim(F.coalesce(new_label, F.lit(""))) != ""
    return F.coalesce(said, F.when(new, F.lit(vocabulary.OTHER_NAME)).otherwise(F.lit(vocabulary.NO_OTHER_NAME)))


def reason_counts(reasons: DataFrame, column: str) -> DataFrame:
    """(reason, n) over the parts of all reasons between semicolons."""
    part = F.explode(F.split(column, ";"))
    return reasons.select(part.alias("p")).select(F.trim("p").alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def recommended_pairs(decisions: DataFrame, texts: str, cluster: str, valid: Sequence[str]) -> DataFrame:
    """(cluster_a, cluster_b, place) of the groups that a decision's texts name, each pair once, in order: the decision's own with each it names."""
    found = decisions.select(F.col(cluster).cast("string").alias("own"), F.posexplode(texts).alias("k", "t")).select("own", "k", F.posexplode(ids_in(F.col("t"), F.lit(list(valid)))).alias("j", "other")).where("own <> other")
    low = F.col("own").cast("int") < F.col("other").cast("int")
    pairs = found.select(F.when(low, F.col("own")).otherwise(F.col("other")).alias("cluster_a"), F.when(low, F.col("other")).otherwise(F.col("own")).alias("cluster_b"), F.struct(F.col("own").cast("int").alias("o"), "k", "j").alias("place"))
    first = pairs.groupBy("cluster_a", "cluster_b").agg(F.min("place").alias("first"))
    return first.select("cluster_a", "cluster_b", F.row_number().over(Window.orderBy("first")).alias("place"))


def merged_queue(queues: Sequence[DataFrame], most: int) -> DataFrame:
    """(cluster_a, cluster_b, place): pairs of all queues (a, b, place), lower number first, each once, earlier queues first, up to most."""
    every = reduce(DataFrame.unionByName, [q.select(F.least(F.col("a").cast("int"), F.col("b").cast("int")).alias("cluster_a"), F.greatest(F.col("a").cast("int"), F.col("b").cast("int")).alias("cluster_b"), F.lit(k).alias("queue"), F.col("place")) for k, q in enumerate(queues)])
    first = every.groupBy("cluster_a", "cluster_b").agg(F.min(F.struct("queue", "place")).alias("at"))
    return first.orderBy("at").limit(most).select("cluster_a", "cluster_b", F.row_number().over(Window.orderBy("at")).alias("place"))


def label_kinds(mapping: DataFrame, cluster: str, label: str, original: str) -> DataFrame:
    """(label, n_clusters, n_originals, kept, merged, refined): kept if a group keeps its original label, merged if the label
    joins two groups of two originals or three groups, refined if a group's differs from its original."""
    out = mapping.groupBy(label).agg(F.count_distinct(cluster).alias("n_clusters"), F.count_distinct(original).alias("n_originals"), F.bool_or(F.col(label) == F.col(original)).alias("kept"), F.bool_or(F.col(label) != F.col(original)).alias("refined"))
    return out.withColumn("merged", (F.col("n_clusters") >= 2) & ((F.col("n_originals") >= 2) | (F.col("n_clusters") >= 3)))


def lineage_themes(mapping: DataFrame, label: str) -> DataFrame:
    """One row: which themes the set of labels holds."""
    c = F.col(label)
    return mapping.agg(F.bool_or(c.contains("Cytotoxic")).alias("cytotoxic"), F.bool_or(c.contains("Tissue-Resident") | c.startswith("Lung")).alias("tissue"), F.bool_or(c.contains("Cytokine-Stimulated")).alias("cytokine"), F.bool_or(c.contains("Proliferative")).alias("proliferative"), F.bool_or(c.isin("T", "B", "Myeloid-like", "Unknown_BM_1 Erythroid-like")).alias("other_lineages"))


def validation_question(label: Column, original: Column, programs: Column, high_other: Column) -> Column:
    """programs: array of the names of programs hit."""
    return (
        F.when(label == original, F.lit(vocabulary.QUESTIONS["kept"]))
        .when(label.isin(*vocabulary.OTHER_LINEAGES), F.lit(vocabulary.QUESTIONS["lineage"]))
        .when(F.array_contains(programs, "proliferation"), F.lit(vocabulary.QUESTIONS["proliferation"]))
        .when(F.array_contains(programs, "NK tissue/regulatory/chemokine"), F.lit(vocabulary.QUESTIONS["tissue"]))
        .when(high_other, F.lit(vocabulary.QUESTIONS["flags"]))
        .otherwise(F.lit(vocabulary.QUESTIONS["refined"]))
    )


def rule_based(evidence: DataFrame, known: Sequence[str] = vocabulary.REFINED_LABELS) -> DataFrame:
    """An offline decision for each group: keep its draft label if it is known, with a confidence from its share."""
    label = F.when(F.col("draft").isin(*known), F.col("draft"))
    confidence = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(5 * F.col("share")).cast("int")))
    return evidence.withColumns({"candidate_label": F.coalesce(label, F.lit("Mature Cytotoxic")), "suggested_new_label": F.when(label.isNull(), F.col("draft")).otherwise(F.lit("")), "confidence_score": confidence, "ambiguity_score": 5 - confidence, "technical_concern_score": F.when(F.col("share") < 0.5, 2).otherwise(0), "needs_human_review": label.isNull() | (confidence < 3)})


def decided(evidence: DataFrame, decide: Callable[[DataFrame], DataFrame] = rule_based, *, rounds: int = 3, gather: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rounds of decisions over groups: those that triage does not lock get more evidence (gather) and are decided again, up to rounds times.

    Each round is written, so no round is worked out again; it ends early when no group is left.
    """
    scratch = Scratch(evidence.sparkSession, "rounds")
    done, active = None, scratch.keep(evidence, "evidence")
    for n in range(1, rounds + 1):
        now = decide(active).withColumns({"round": F.lit(n), "review_status": triage(F.col("candidate_label"), F.col("confidence_score"), F.col("ambiguity_score"), F.col("technical_concern_score"), F.col("needs_human_review"), F.col("suggested_new_label"))})
        now = scratch.keep(now, f"round{n}")
        last = n == rounds or now.where("review_status <> 'locked'").isEmpty()
        part = now if last else now.where("review_status = 'locked'")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        active = active.join(part.select("cluster"), "cluster", "left_anti")
        active = scratch.keep(gather(active) if gather else active, f"evidence{n}")
    return done


def with_pair_evidence(evidence: DataFrame, results: DataFrame, *, most: int = 2) -> DataFrame:
    """More evidence on groups (cluster, share, n_pairs): each round looks at the next pair results (cluster, place, support) of a group, up to most, and their support adds to its share."""
    seen = results.join(evidence.select("cluster", F.col("n_pairs").alias("seen_")), "cluster").where((F.col("place") >= F.col("seen_")) & (F.col("place") < F.col("seen_") + most))
    more = seen.groupBy("cluster").agg(F.count(F.lit(1)).alias("more_"), F.sum("support").alias("support_"))
    out = evidence.join(more, "cluster", "left")
    return out.withColumns({"n_pairs": F.col("n_pairs") + F.coalesce("more_", F.lit(0)), "share": F.least(F.lit(1.0), F.col("share") + F.coalesce("support_", F.lit(0.0)))}).drop("more_", "support_")


def with_retries(call: Callable, *, attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What call() returns; a failure is tried again after a pause that grows by itself, and the last one is raised."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(pause * n)


def worksheet_note(embedded: Column, explicit: Column) -> Column:
    return combine_notes(embedded, explicit)
