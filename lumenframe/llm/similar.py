"""SimHash near duplicates by the Jaccard similarity of sets of word shingles.

Wide fingerprints, of WORDS 64-bit words, are compared in tiles as those of simhash.py are.  Of two sets of a
similarity s, a bit differs with odds acos(2s / (1 + s)) / pi, so the radius lies so many
standard deviations above the bits that differ at the similarity asked for that next to no pair is lost.  The first
word alone, with a radius of its own, tells nearly all pairs; only those that pass it have the others
compared.  Tiles are named by population counts and by the number of shingles, as sets of a similarity
differ in size by its share at most; tile pairs that differ by more in either are skipped.

Texts that fingerprints connect, directly or through others, are a group of candidates.  Their sets are made
anew and compared exactly within the group, each pair whose fingerprints are near; crowded groups are cut into
blocks whose pairs go to different tasks.  So every link is exact, and links are never
written out: a task returns edges enough to connect what is linked.
"""

from __future__ import annotations

from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, integral_key, kept_by_worker, slices
from .components import Forest, components, link_rows
from .simhash import SEED, majority, shingle_hashes, tile_edges

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint, and standard deviations between the bits expected at the similarity and the radius: of the first word, of all.
WORDS, FIRST_SPREAD, SPREAD = 4, 4.0, 5.0
#: Sets in a block, about, and shingles in all its sets.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Bytes of bitmaps that a task holds.
HELD = 1 << 26
#: Rows that are sent to every task at most, else joined.
SENT = 500_000
#: Against rounding.
SLACK = 1e-9

#: Odd multipliers from a fixed seed: they make further words from a shingle's hash.
_FACTORS = np.random.default_rng(5).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def radii(similarity: float, words: int = WORDS) -> tuple[int, int]:
    """Bits in which the first words, and all words, of sets at the similarity differ at most, but for next to none of them."""
    p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    limit = lambda bits, spread: min(bits, ceil(bits * p + spread * sqrt(bits * p * (1 - p))))
    return limit(64, FIRST_SPREAD), limit(64 * words, SPREAD)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of distinct hashes; zeros without any."""
    if not len(found):
        return np.zeros(words, np.int64)
    more = found[:, None] * _FACTORS[:words]
    more ^= more >> np.uint64(29)
    more *= np.uint64(0xD6E8FEB86659FD93)
    more ^= more >> np.uint64(32)
    return majority(more)


def _mark(text: str) -> Column:
    return F.xxhash64(F.col(text)).alias("mark")


def _rows(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, mark, name, n, f0, f1, ...): mark tells texts apart, name their sets; n is the size of a set, f0 and so on its fingerprint."""

    def work(batches):
        kept_by_worker("similar")
        for batch in slices(batches):
            sets = [shingles(x, width) for x in batch.column(2).to_pylist()]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            prints = np.array([wide_fingerprint(x) for x in sets], np.int64).reshape(-1, WORDS)
            columns = [batch.column(0), batch.column(1), pa.array(names), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "mark", "name", "n", *_PRINTS])

    return docs.select(integral_key(docs, key).alias("key"), _mark(text), F.col(text).alias("text")).mapInArrow(work, "key long, mark long, name long, n long, " + ", ".join(f"{f} long" for f in _PRINTS))


_PRINTS = [f"f{k}" for k in range(WORDS)]


def candidate_edges(classes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): ids of classes (id, n, f0, ...) whose fingerprints are near, thinned to what connects them."""
    first, radius = radii(similarity)
    # Sizes in steps of half the ratio that the similarity allows, and counts in steps of the radius: near tiles are two and one steps away at most.
    size = F.when(F.col("n") > 0, F.floor(F.ln(F.col("n").cast("double")) * (2 / -log(similarity)))).otherwise(-8) if similarity < 1 else F.col("n") * 4
    counts = sum((F.bit_count(f) for f in _PRINTS), F.lit(0))
    tile = size * 64 + F.floor(counts / (radius + 1))
    near = [64 * s + c for s in (0, 1, 2) for c in (-1, 0, 1) if (s, c) >= (0, 0)]
    return tile_edges(classes, tile, near, _PRINTS, first, radius, scratch)


def common_members(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many members left[i] and right[j] have in common, where wanted[i, j]; 0 elsewhere. By bitmaps of the members that two sets or more have."""
    out = np.zeros(wanted.shape, np.int32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    owner, at = np.repeat(np.arange(len(sets)), sizes)[shared[at]], place[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = max(64, HELD // max(1, len(sets)) * 8 // 8 // 64 * 64)
    for a in range(0, int(shared.sum()), width):
        some = slice(*np.searchsorted(at, [a, a + width]))
        bits = np.zeros((len(sets), min(width, -(-(int(shared.sum()) - a) // 64) * 64)), bool)
        bits[owner[some], at[some] - a] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        for i in np.flatnonzero(wanted.any(1)).tolist():
            js = np.flatnonzero(wanted[i])
            step = max(1, (1 << 20) // maps.shape[1])
            for k in range(0, len(js), step):
                part = js[k : k + step]
                out[i, part] += np.bitwise_count(maps[left[i]] & maps[right[part]]).sum(1, dtype=np.int32)
    return out


def _linked(groups: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): edges between sets (id, part, shingles, f0, ...) of one part whose similarity is reached, thinned to what connects them."""
    _, radius = radii(similarity)
    load = F.greatest(F.count(F.lit(1)) / F.lit(float(BLOCK)), F.sum(F.size("shingles")) / F.lit(float(BLOCK_SHINGLES)))
    crowded = scratch.keep(groups.groupBy("part").agg(F.ceil(load).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    sent = F.broadcast(crowded) if crowded.limit(SENT + 1).count() <= SENT else crowded
    dealt = groups.join(sent, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))).alias("m")
    pairs = dealt.select("part", "block", "id", "shingles", *_PRINTS, meets).select("part", "m.i", "m.j", "block", "id", "shingles", *_PRINTS)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j, side, ids = table["i"][0].as_py(), table["j"][0].as_py(), table["block"].to_numpy(), table["id"].to_numpy()
        lists = table["shingles"].chunk(0)
        sets = np.split(np.asarray(lists.flatten()), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        prints = [table[f].to_numpy().view(np.uint64) for f in _PRINTS]
        left, right = (np.flatnonzero(side == k) for k in (i, j))
        forest = Forest()
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            wanted = sum((np.bitwise_count(p[rows][:, None] ^ p[right]).astype(np.int32) for p in prints), np.zeros((len(rows), len(right)), np.int32)) <= radius
            wanted &= rows[:, None] < right if i == j else rows[:, None] != right
            total = sizes[rows][:, None] + sizes[right]
            wanted &= np.minimum(sizes[rows][:, None], sizes[right]) + SLACK >= similarity * np.maximum(sizes[rows][:, None], sizes[right])
            if wanted.any():
                some = np.flatnonzero(wanted.any(0))
                both = np.zeros(wanted.shape, np.int32)
                held = np.concatenate([rows, right[some]])
                both[:, some] = common_members([sets[k] for k in held.tolist()], np.arange(len(rows)), len(rows) + np.arange(len(some)), wanted[:, some])
                hits = wanted & (both + SLACK >= similarity * (total - both))
                if hits.any():
                    link_rows(forest, ids[rows], ids[right], hits)
        a, b = forest.edges()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, mark, component) of every row; mark is the XXH64 of its text, component a number of its group.

    Rows of one component are connected by pairs of texts of the given similarity or more.  Null and empty
    texts, and all without words, are alike.  Texts of any length are read whole.  Rows of equal or null key count each by its own
    text.  An empty table gives none.  Keys must be whole numbers (TypeError).  Columns but the two named are not read.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.keep(_rows(docs, key, text, shingle), "rows")
    same = ["name", "n", *_PRINTS]
    # Equal sets meet here, combined before the shuffle: one row for each from now on.
    classes = scratch.keep(rows.groupBy(*same).agg(F.min("mark").alias("mark")).select(F.monotonically_increasing_id().alias("id"), *same, "mark"), "classes")
    parts = scratch.keep(components(candidate_edges(classes, similarity, scratch), scratch).withColumnRenamed("component", "part"), "parts")
    needed = scratch.keep(classes.join(parts, F.col("id") == F.col("node")).select("id", "part", F.col("name").alias("name_"), F.col("mark").alias("mark_")), "needed")
    few = F.broadcast(needed) if needed.count() <= SENT else needed
    texts = docs.select(F.col(text).alias("text_"), _mark(text)).join(few, F.col("mark") == F.col("mark_")).select("id", "part", "name_", "text_").dropDuplicates(["id"])

    def sets(batches):
        for batch in slices(batches):
            found = [shingles(x, shingle) for x in batch.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            prints = np.array([wide_fingerprint(x) for x in found], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS))], names=["id", "part", "shingles", *_PRINTS])

    held = scratch.keep(texts.mapInArrow(sets, "id long, part long, shingles array<long>, " + ", ".join(f"{f} long" for f in _PRINTS)), "sets")
    linked = components(_linked(held, similarity, scratch), scratch)
    scratch.drop(held, parts, needed)
    named = classes.join(linked, F.col("id") == F.col("node"), "left").select(*[F.col(c).alias(f"{c}_") for c in same], F.coalesce("component", "id").alias("component"))
    on = [F.col(c) == F.col(f"{c}_") for c in same]
    out = scratch.keep(rows.join(named, on, "left").select("key", "mark", "component"), "components")
    scratch.drop(rows, classes)
    return out


def first_of_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, with its own columns: that of the smallest key (none is the largest), of one key the smallest mark, and of equal ones any.

    Nulls, empty texts, repeated rows and empty tables as in near_duplicates().  What goes is decided by row (key and
    text), so a text stays though another of the same key goes.  All columns are carried along as they are.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found = near_duplicates(docs, key=key, text=text, **options).groupBy("component", "key", "mark").agg(F.count(F.lit(1)).alias("n"))
    found = scratch.keep(found, "rows")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("best"))
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("mark") == F.col("best.mark"))
    found = scratch.keep(found.join(best, "component").select(F.col("key").alias("key_"), F.col("mark").alias("mark_"), stays.alias("stays"), "n").where("NOT stays OR n > 1"), "changed")
    few = lambda df: F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df
    marked = docs.select(F.struct("*").alias("row_"), integral_key(docs, key).alias("own_"), _mark(text).alias("of_"))
    same = (F.col("own_").eqNullSafe(F.col("key_"))) & (F.col("of_") == F.col("mark_"))
    once = marked.join(few(found), same, "left_anti")
    again = scratch.keep(found.where("stays"), "again")
    again = marked.join(few(again), same, "left_semi").dropDuplicates(["own_", "of_"])
    return once.unionByName(again).select("row_.*")
