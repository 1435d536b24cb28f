"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Each text's word 1-grams and 2-grams are hashed into a fixed number of buckets.  Two
multinomials over the buckets are estimated: the raw corpus, from all documents, and
the trusted target, from labelled documents.  A document's score is the sum of
log(target / raw) over its n-grams divided by their number plus a prior number, so
that a handful of n-grams weighs little; it is kept at or above a threshold, which
the trusted documents' own scores set.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

BUCKETS = 8192
#: Keys of labelled documents that are sent to every task at most; more are joined. All of them count, whatever their number.
TRUSTED_SENT = 500_000
#: n-grams of ratio 1 that each document has besides its own.
PRIOR_GRAMS = 32
#: The threshold is the score that this share of the trusted documents, at most, is below.
TRUSTED_LOST = 0.001

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _words(text: Column) -> Column:
    """Words in order; none for null."""
    return F.coalesce(F.filter(F.split(text, SPACES), lambda w: w != ""), F.array().cast("array<string>"))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _indices(size: Column, width: int) -> Column:
    """0 .. size - width; empty if there are fewer than width."""
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def _buckets(buckets: int) -> Column:
    """Buckets of the 1-grams and 2-grams of column hashes."""
    ones = F.transform("hashes", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.transform(_indices(F.size("hashes"), 2), lambda i: F.pmod(F.xxhash64(_at("hashes", i), _at("hashes", i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(ones, twos)


def _trusted_ids(trusted: DataFrame, key: str, most_sent: int) -> DataFrame | None:
    """Distinct keys, all of them, to be sent to every task if there are no more than so many; None without any."""
    ids = trusted.select(F.col(key).alias("trusted_")).where("trusted_ IS NOT NULL").distinct()
    n = ids.count()
    if not n:
        return None
    return F.broadcast(ids) if n <= most_sent else ids


def log_ratios(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, most_sent: int = TRUSTED_SENT) -> list[float]:
    """log(target / raw) of each bucket, with one added to every count. All zero without trusted documents.

    Null and empty texts have no n-grams; rows of equal key count each; null and repeated keys of trusted, and those of no document, change nothing. An
    empty table leaves all counts at one. Texts of any length are read whole; columns but the two named are not read.
    """
    ids = _trusted_ids(trusted, key, most_sent)
    if ids is None:
        return [0.0] * buckets
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(ids, F.col("key_") == F.col("trusted_"), "left")
    rows = rows.select("trusted_", F.transform(_words(F.col("text_")), lambda w: F.xxhash64(w)).alias("hashes"))
    grams = rows.select(F.explode(_buckets(buckets)).alias("bucket"), F.col("trusted_").isNotNull().cast("long").alias("in_target"))
    # One row for each bucket, a fixed number of rows, comes to the driver.
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("in_target").alias("target"))
    raw_total, target_total = (F.sum(c).over(_all()) + buckets for c in ("raw", "target"))
    found = counts.select("bucket", (F.ln((F.col("target") + 1) / target_total) - F.ln((F.col("raw") + 1) / raw_total)).alias("ratio")).collect()
    out = [0.0] * buckets
    for r in found:
        out[r.bucket] = r.ratio
    return out


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def base_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """(key, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words[, keep]); a null text has no words."""
    t = F.col("text_")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text_"), *([keep.alias("keep")] if keep is not None else []))
    kept = ["keep"] if keep is not None else []
    rows = rows.select(
        "key",
        *kept,
        F.transform(_words(t), lambda w: F.xxhash64(w)).alias("hashes"),
        zero(F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"),
        zero(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"),
        lines.alias("lines"),
    )
    window5 = F.transform(_indices(F.size("hashes"), 5), lambda i: F.xxhash64(*[_at("hashes", i + k) for k in range(5)]))
    rows = rows.select("key", *kept, "hashes", "word_chars", "n_symbols", zero(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), window5.alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # Windows sorted with their places; equal neighbours are windows found twice or more.
    rows = rows.select("*", F.when(repeats, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("sorted")).drop("windows")
    twins = F.filter(F.zip_with("sorted", F.slice("sorted", 2, F.size("sorted")), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    rows = rows.select("*", F.sort_array(F.array_distinct(F.flatten(twins))).alias("starts")).drop("sorted")
    reach = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.select("key", *kept, "hashes", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", zero(covered).alias("n_repeat_words"))


def _scored(docs: DataFrame, ratios: list[float], *, key: str, text: str, keep: Column | None, prior: int, buckets: int) -> DataFrame:
    """base_columns with base_failed and score."""
    rows = base_columns(docs, key=key, text=text, keep=keep)
    rows = rows.withColumn("buckets_", _buckets(buckets))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded into one constant
    total = F.aggregate("buckets_", F.lit(0.0), lambda s, b: s + F.get(table, b))
    rows = rows.withColumn("score", total / (F.size("buckets_") + F.lit(prior)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.drop("hashes", "buckets_").withColumn("base_failed", failed)
    # A caller's filter would be pushed through the projections, which multiplies their expressions; a generator stops it.
    return rows.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


def trusted_threshold(docs: DataFrame, trusted: DataFrame, ratios: list[float], *, key: str = "doc_id", text: str = "text", prior: int = PRIOR_GRAMS, buckets: int = BUCKETS, most_sent: int = TRUSTED_SENT, lost: float = TRUSTED_LOST) -> float:
    """The score at share lost of the trusted documents that pass the base rules, rounded; without any, what every score is above.

    Nulls, repeats, long texts and other columns as in log_ratios(); each row of a trusted key counts. Of equal scores any is the threshold.
    """
    ids = _trusted_ids(trusted, key, most_sent)
    if ids is None:
        return float("-inf")
    mine = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(ids, F.col("key_") == F.col("trusted_"), "left_semi")
    scores = _scored(mine, ratios, key="key_", text="text_", keep=None, prior=prior, buckets=buckets).where(~F.col("base_failed"))
    found = scores.agg(F.expr(f"percentile_disc({lost}) WITHIN GROUP (ORDER BY round(score, 9))").alias("t")).first().t
    return float("-inf") if found is None else found


def judge(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", keep: Column | None = None, threshold: float | None = None, prior: int = PRIOR_GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept[, keep]) of every document.

    trusted has the keys of trusted documents; without a threshold, theirs is taken.  Null and
    empty texts have no words and fail the base rules.  Rows of equal key are judged each by its own text.  An empty
    table gives none.  Other columns are not read.
    """
    ratios = log_ratios(docs, trusted, key=key, text=text, buckets=buckets)
    if threshold is None:
        threshold = trusted_threshold(docs, trusted, ratios, key=key, text=text, prior=prior, buckets=buckets)
    rows = _scored(docs, ratios, key=key, text=text, keep=keep, prior=prior, buckets=buckets)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.round("score", 9) >= threshold))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """The keys of documents labelled good and not toxic: a null label is neither; a key labelled twice comes twice, which changes nothing."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


def good_documents(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names; nulls, repeats and empty tables as in judge()."""
    return judge(docs, trusted, key=key, text=text, keep=F.struct("*"), **options).where("kept").select("keep.*")
