"""Sampling and splitting in the order of a hash of the key: the same rows whatever the partitioning.

Ranks within a group are exact and yet never made by one task for a whole group: rows are ranked within the
group's slice of the hash, after the counts of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of the hash that make a slice: 4096 slices of each group.
SLICE_DIGITS = 3


def hash_order(key: str | Column, seed: int | str) -> Column:
    """MD5 of 'key|seed', in hexadecimal."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", k.cast("string"), F.lit(str(seed))).cast("binary"))


def hash_ranked(df: DataFrame, groups: Sequence[str], key: str, seed: int | str, to: str) -> DataFrame:
    """df with its rank, from 1, within the groups (all rows if none) in the order of the hash, then the key."""
    hashed = df.withColumn("h_", hash_order(key, seed)).withColumn("s_", F.substring("h_", 1, SLICE_DIGITS))
    named = [F.col(g).alias(f"g{k}_") for k, g in enumerate(groups)]
    keys = [f"g{k}_" for k in range(len(groups))]
    counts = hashed.groupBy(*named, F.col("s_").alias("t_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("t_")) - F.col("n_")
    counts = counts.select(*keys, "t_", before.alias("before_"))
    on = F.col("s_") == F.col("t_")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"g{k}_"))
    within = Window.partitionBy(*groups, "s_").orderBy("h_", key)
    return hashed.join(counts, on).withColumn(to, F.col("before_") + F.row_number().over(within)).drop("h_", "s_", "t_", "before_", *keys)


def cap_classes(df: DataFrame, label: str, key: str, caps: Mapping[str, int], seed: int = 0) -> DataFrame:
    """At most so many rows of each class named in caps. Only those classes are ranked; all others pass by."""
    named = df.where(F.col(label).isin(*caps))
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(label)]
    kept = hash_ranked(named, [label], key, seed, "n_").where(F.col("n_") <= most).drop("n_")
    return df.where(~F.coalesce(F.col(label).isin(*caps), F.lit(False))).unionByName(kept)


def major_ratio(df: DataFrame, label: str, key: str, major: str, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """The major class is cut to ratio times all other rows, null labels among them, if that is above 0 and below its size."""
    is_major = F.col(label).eqNullSafe(F.lit(major))
    counts = df.agg(F.count_if(is_major).alias("n_major"), F.count_if(~is_major).alias("n_other"))
    target = F.floor(F.lit(ratio) * F.col("n_other"))
    limit = counts.select(F.when((target > 0) & (F.col("n_major") > target), target).alias("limit_"))  # one row
    mine = hash_ranked(df.where(F.col(label) == major), [], key, seed, "n_").join(F.broadcast(limit))
    return df.where(~is_major).unionByName(mine.where(F.col("limit_").isNull() | (F.col("n_") <= F.col("limit_"))).drop("n_", "limit_"))


def stratified_split(df: DataFrame, label: str, key: str, held_out: Column, *, share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with split: Held-out rows (a null mark is none); of the rest, share in all (rounded up) is Val and the others are Train.

    Each label has its part of the Train rows, rounded down, and the labels with the largest remainders (of equals the smaller label, null last) have one more
    until the number is reached. A null label is one of its own.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    rest = df.where(~held_out)
    every = Window.partitionBy(F.lit(1))  # a row for each label
    sizes = rest.groupBy(F.col(label).alias("l_")).agg(F.count(F.lit(1)).alias("c_"))
    sizes = sizes.withColumn("n_", F.sum("c_").over(every)).withColumn("train_", F.col("n_") - F.ceil(F.round(F.lit(share) * F.col("n_"), 9)))
    sizes = sizes.withColumns({"whole_": F.expr("(c_ * train_) div n_"), "left_": F.expr("(c_ * train_) % n_")})
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("left_"), F.col("l_").asc_nulls_last()))
    more = (place <= F.col("train_") - F.sum("whole_").over(every)).cast("long")
    sizes = sizes.select("l_", (F.col("c_") - F.col("whole_") - more).alias("val_"))
    ranked = hash_ranked(rest, [label], key, seed, "n_").join(sizes, F.col(label).eqNullSafe(F.col("l_")))
    tagged = ranked.withColumn("split", F.when(F.col("n_") <= F.col("val_"), F.lit("Val")).otherwise(F.lit("Train"))).drop("n_", "val_", "l_")
    return tagged.unionByName(df.where(held_out).withColumn("split", F.lit("Held-out")))


def reuse_split(df: DataFrame, key: str, splits: DataFrame) -> DataFrame:
    """df with split from an earlier run's (key, split); rows that are new go to Train."""
    return df.join(splits.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("Train")))


def proportional_sample(df: DataFrame, label: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """About most rows: of each label its share (half to even, at least one); if that is still too many, the last in hash order go."""
    sizes = df.groupBy(F.col(label).alias("l_")).agg(F.count(F.lit(1)).alias("n_")).withColumn("all_", F.sum("n_").over(Window.partitionBy(F.lit(1))))
    take = F.when(F.col("all_") <= most, F.col("n_")).otherwise(F.least("n_", F.greatest(F.lit(1), F.bround(F.col("n_") / F.col("all_") * most).cast("long"))))
    picked = hash_ranked(df, [label], key, seed, "r_").join(sizes.select("l_", take.alias("take_")), F.col(label).eqNullSafe(F.col("l_"))).where("r_ <= take_").drop("r_", "take_", "l_")
    return hash_ranked(picked, [], key, f"{seed}t", "r_").where(F.col("r_") <= most).drop("r_")


def sample_per_group(df: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    return hash_ranked(df, [group], key, seed, "r_").where(F.col("r_") <= most).drop("r_")
