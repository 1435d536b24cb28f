"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target in words, and each document of it an expected number of copies: in proportion to a preference,
a whole number made from its size (longer documents weigh more, as the root of their words), no copies beyond
most, and so that the source's expected words are its target.  The integral part is allocated as certain whole copies.
What is left, p, is the odds of one more: documents are ranked by random odds divided by inclusion
odds, q = (u / (1 - u)) / (p / (1 - p)), and the first in that order are taken, so
many that their words come nearest to what is left of the target.  u is a hash of
the key, the text, the row's number among rows of the same key and text, and the seed: every row has its own draw, and reruns agree.

Where the order is to be cut is found without sorting a source in one task: counts of
words by (source, slice of q), a slice of that slice, and at last the few distinct
ranks left in it.  Applying the cut needs one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, numbered

#: Sources are sent to every task only up to this many rows; beyond it the join is a shuffled one, which AQE splits where a source is hot.
BROADCAST_SOURCES = 50_000
#: Slices of the rank at each of the two levels.
SLICES = 4096


def word_count(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(name: Column, copy: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of 'name:copy:seed'."""
    name = F.concat(name, F.lit(":"), copy.cast("string"), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3, total: float | None = None) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last; none above most times its size.

    A target that its weight would take above the cap stops there, and the excess is
    shared again by weight: the fill level is total less the caps, over the weights, of
    the sources below their caps, in the order of cap / weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.lit([float(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    out = sources.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)})
    out = out.withColumns({"fills_at": F.col("cap") / F.col("weight"), "total": F.sum(F.col("source_size").cast("double")).over(every) if total is None else F.lit(float(total)), "all_weights": F.sum("weight").over(every)})
    out = out.withColumn("level", F.try_divide(F.col("total") - before("cap"), F.col("all_weights") - before("weight")))
    # Sources are full up to the first that the level leaves below its cap; that one's level holds for it and all later.
    out = out.withColumn("final_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fills_at", "level"))).over(every)["level"])
    target = F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", target.alias("target"))


def length_preference(size: Column) -> Column:
    """The root of a document's words, rounded down, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(size.cast("double"))).cast("long"))


def copy_levels(sized: DataFrame, targets: DataFrame, *, most: int = 3) -> DataFrame:
    """targets with level: a document of preference w is expected least(most, level * w) times, which adds up to the target.

    Documents count by their preference alone, so a source is a row for each preference that occurs, whatever its
    size.  From the largest preference down, those that the level takes to most copies are full; the level is what is left of the
    target over the preference-weighted words of the others.  Sums are of whole numbers, so no order of summation shows.
    """
    classes = sized.groupBy(F.col("source").alias("source_c"), "preference").agg(F.sum("size").alias("words"))
    classes = classes.join(targets.select(F.col("source").alias("source_t"), "target"), F.col("source_c").eqNullSafe(F.col("source_t"))).drop("source_t")
    by = Window.partitionBy("source_c").orderBy(F.desc("preference"))
    larger, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("words").over(larger), F.lit(0).cast("long"))
    level = F.try_divide(F.col("target") - F.lit(float(most)) * full.cast("double"), F.sum(F.col("words") * F.col("preference")).over(rest).cast("double"))
    classes = classes.withColumn("level", level)
    # The first that is not full has the level of all after it.
    found = classes.where(F.col("level") * F.col("preference") <= F.lit(float(most))).groupBy("source_c").agg(F.max_by("level", "preference").alias("level"))
    out = targets.join(found, F.col("source").eqNullSafe(F.col("source_c")), "left").drop("source_c")
    return out.withColumn("level", F.coalesce("level", F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))))


def _joined(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "source_")
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def _expected(most: int) -> Column:
    return F.least(F.lit(float(most)), F.col("level") * F.col("preference"))


def _rank(u: Column, expected: Column) -> Column:
    """q / (1 + q), in the order of q. Null if no more than whole copies are expected."""
    share = expected - F.floor(expected)
    q = F.try_divide(u / (F.lit(1.0) - u), share / (F.lit(1.0) - share))
    return q / (F.lit(1.0) + q)


def _cut(ranked: DataFrame, slot: Column, scratch: Scratch, name: str) -> DataFrame:
    """For each source the slot in which the words reach its budget, and the words before it."""
    counts = ranked.groupBy("source", "budget", slot.alias("slot")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("words").over(order) + F.col("before") if "before" in counts.columns else F.sum("words").over(order))
    return scratch.keep(reached.where("upto >= budget").groupBy("source", "budget").agg(F.min(F.struct("slot", "upto", "words")).alias("at")).select("source", "budget", F.col("at.slot").alias("slot"), (F.col("at.upto") - F.col("at.words")).alias("before"), F.col("at.words").alias("words")), name)


def _sized(docs: DataFrame, key: str, text: str, source: str, preference: Column | None, *more: Column) -> DataFrame:
    """(key, source, size, preference, name): name is the key and the MD5 of the text, empty ones for nulls."""
    size = word_count(f"`{text}`")
    weight = length_preference(size) if preference is None else F.greatest(F.lit(1).cast("long"), F.coalesce(preference.cast("long"), F.lit(1).cast("long")))
    name = F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("")))
    return docs.select(*more, F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size.alias("size"), weight.alias("preference"), name.alias("name"))


def _drawn(sized: DataFrame, repeated: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """sized with u, in the place of name. Rows of repeated names (name_) are numbered, whatever their order, as they differ in nothing that is drawn by; a hot name is in no one task."""
    few = F.broadcast(repeated) if repeated.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else repeated
    same = F.col("name") == F.col("name_")
    single = sized.join(few, same, "left_anti").withColumn("u", uniform(F.col("name"), F.lit(0), seed)).drop("name")
    if repeated.isEmpty():
        return single
    several = sized.join(few, same, "left_semi").withColumnRenamed("name", "group").withColumn("row", F.monotonically_increasing_id())
    several = numbered(scratch.keep(several, "repeated"), scratch, F.col("row").asc())
    return single.unionByName(several.withColumn("u", uniform(F.col("group"), F.col("index"), seed)).select(single.columns))


def plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", preference: Column | None = None, weights: Sequence[float] = (5, 2, 1), most: int = 3, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(rows, sources, number of sources, repeated): rows (key, source, size, u, preference); sources (source, source_size, target, level, cut, with_cut); repeated the names of rows that occur more than once.

    preference is a whole number for each document (null and less than 1 count as 1), by default length_preference(); its
    values should be few, as a source has a row for each of them.  A document takes the whole copies expected, and one more if its
    rank is below its source's cut, or at it if with_cut.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(_sized(docs, key, text, source, preference), "sized")
    repeated = scratch.keep(sized.groupBy(F.col("name").alias("name_")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("name_"), "names")
    rows = scratch.keep(_drawn(sized, repeated, seed, scratch), "rows")
    sources = scratch.keep(copy_levels(rows, source_targets(rows, weights=weights, most=most, total=total), most=most), "sources")
    n = sources.count()
    expected = _expected(most)
    levels = _joined(rows, sources.select("source", "target", "level"), n)
    certain = levels.groupBy(F.col("source").alias("source_")).agg(F.sum(F.floor(expected) * F.col("size")).alias("certain"))
    budgets = scratch.keep(sources.join(certain, F.col("source").eqNullSafe(F.col("source_"))).select("source", "level", (F.col("target") - F.col("certain").cast("double")).alias("budget")), "budgets")
    v = F.floor(F.col("v") * SLICES)
    ranked = _joined(rows, budgets.where("budget > 0"), n).select("source", "size", "budget", _rank(F.col("u"), expected).alias("v")).where("v IS NOT NULL")
    first = _cut(ranked, v, scratch, "first")
    low = ranked.drop("budget").withColumn("slice", v)
    low = _joined(low, first.select("source", "budget", "before", F.col("slot").alias("at")), n).where("slice = at")
    left = low.withColumn("budget", F.col("budget") - F.col("before")).drop("before")
    finer = F.floor((F.col("v") * SLICES - F.col("slice")) * SLICES)
    second = _cut(left, finer, scratch, "second")
    last = _joined(left.drop("budget").withColumn("slice", finer), second.select("source", "budget", "before", F.col("slot").alias("at2")), n).where("slice = at2")
    third = _cut(last.withColumn("budget", F.col("budget") - F.col("before")).drop("before"), F.col("v"), scratch, "third")
    nearer = (F.col("before") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("before"))
    cuts = third.select(F.col("source").alias("source_"), F.col("slot").alias("cut"), nearer.alias("with_cut"))
    out = sources.join(cuts, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    return rows, scratch.keep(out, "cuts"), n, repeated


def _copies(most: int) -> Column:
    expected = _expected(most)
    v = _rank(F.col("u"), expected)
    sampled = F.coalesce((v < F.col("cut")) | (F.col("with_cut") & (v == F.col("cut"))), F.lit(False))
    return (F.floor(expected) + sampled.cast("long")).cast("long")


def mix(docs: DataFrame, *, most: int = 3, **options) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every document; see plan() for the options.

    Null and empty texts have size 0; a null source is a source of its own, the last; rows of equal or null key have each their own draw, equal rows, too.  A source's taken words differ from its target by half of one document's
    size, at most (that of the document at which the order is cut), or by what all its documents lack.  An empty table gives none.
    Keys may be of any type.  Other columns are not read.
    """
    rows, sources, n, _ = plan(docs, most=most, **options)
    out = _joined(rows, sources, n).withColumn("copies", _copies(most))
    return out.select("key", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", preference: Column | None = None, most: int = 3, seed: int = 17, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns only.

    Nulls, empty texts and repeated rows as in mix(); an empty table gives none.  All columns are carried along as they are.
    """
    _, sources, n, repeated = plan(docs, key=key, text=text, source=source, preference=preference, most=most, seed=seed, **options)
    held = _drawn(_sized(docs, key, text, source, preference, F.struct("*").alias("doc")), repeated, seed, Scratch(docs.sparkSession, "mixing"))
    out = _joined(held, sources, n).withColumn("copies", _copies(most)).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc.*")
