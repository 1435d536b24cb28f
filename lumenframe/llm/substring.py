"""Exact repeated passages, by doubling the length of windows that are repeated.

A window of words is removed where its word sequence also starts earlier.  Windows of
a short length are counted first; those repeated at it alone are extended to twice
that length and counted again, and so on up to the length asked for, where the first
start of each sequence is found and all others are removed.

Every window of full length is followed through the levels by one part of it, picked
by content alone: at the first level the part whose hash is smallest, at each later
level that part extended to the right, or from the end of the window back if it would
reach beyond.  Equal windows have equal parts, so a window whose part is found once is
found once, and a fraction of the short windows is counted instead of all.

What a level finds out goes back to the documents as places to give up (what occurs
once), so hot sequences are only ever counted, with counts combined before they are
shuffled, never joined or gathered.  Texts are dealt by document once; the last
pass carries the other columns along.  Exact copies of a whole text take part as one text, the first;
of the others all words go, which is what their windows would say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, integral_key, kept_by_worker, slices

WINDOW = 20
LEVELS = 3

#: Odd multipliers from a fixed seed, a row for each of two hashes.
_FACTORS = np.random.default_rng(20).integers(0, 2**63, (2, 1024), np.uint64) * np.uint64(2) + np.uint64(1)


def lengths(window: int, levels: int) -> list[int]:
    """Window lengths from the first level to the last: the last is window, each before it half of the next, rounded up."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of length words."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out += hashes[k : k + n] * _FACTORS[which, k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of its smallest, the leftmost of equals."""
    at = np.arange(len(values))
    span = 1
    while 2 * span <= width:
        left, right = at[: len(at) - span], at[span:]
        at = np.where(values[left] <= values[right], left, right)
        span *= 2
    n = len(values) - width + 1
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(values[left] <= values[right], left, right)


def follow(hashes: np.ndarray, sizes: list[int], given_up: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, place of its part) of the full windows that are left after the levels whose given-up places are known."""
    window = sizes[-1]
    starts = np.arange(len(hashes) - window + 1)
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = smallest(window_hashes(hashes, sizes[0]), window - sizes[0] + 1)
    for level, gone in enumerate(given_up):
        left = ~np.isin(parts, gone)
        starts, parts = starts[left], parts[left]
        parts = np.minimum(parts, starts + window - sizes[level + 1])
    return starts, parts


def _levels_of(batch: pa.RecordBatch, first: int, count: int | None = None) -> list[list[np.ndarray]]:
    """Columns from first on (all, or count of them), each an array of places or null, as arrays for each row."""
    none = np.zeros(0, np.int64)
    columns = [batch.column(k).to_pylist() for k in range(first, batch.num_columns if count is None else first + count)]
    return [[none if x is None else np.array(x, np.int64) for x in row] for row in zip(*columns, strict=True)] if columns else [[] for _ in range(batch.num_rows)]


def _doc() -> list[Column]:
    """What a document is joined on: its key, and whether it has one (no key is not key 0)."""
    return [F.coalesce("key", F.lit(0)).alias("doc"), F.col("key").isNotNull().alias("named")]


def removals(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, levels: int = LEVELS, carry: Sequence[Column] = ()) -> tuple[DataFrame, list[int]]:
    """Texts with what to give up: (key, hash, text, copy, gone0, gone1, ..., firsts, carried columns), and the lengths of the levels.

    Windows of a text are what follow() leaves of it; those not in firsts are to be removed. Of a copy, all are.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    sizes = lengths(window, levels)
    own = [integral_key(docs, key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")]
    base = docs.select(*own)
    # Copies are known by 128 bits of their text and its length.
    named = base.where("text IS NOT NULL").select("key", "hash", F.xxhash64(F.lit(1), "text").alias("hash2"), F.octet_length("text").alias("bytes"))
    groups = scratch.keep(named.groupBy("hash", "hash2", "bytes").agg(F.min("key").alias("first"), F.max(F.col("key").isNull()).alias("unnamed"), F.count(F.lit(1)).alias("copies")), "texts")
    first = F.when(F.col("unnamed"), None).otherwise(F.col("first"))  # nulls come first
    low, high, longest, named_twice = groups.select(first.alias("first"), "bytes").agg(F.min("first"), F.max("first"), F.max("bytes"), F.count(F.lit(1)) - F.count_distinct("first")).first()
    # A copy's key is above the first of its text, so (key, hash) tells copies from firsts.
    copied = groups.where("copies > 1").select(F.col("hash").alias("hash_"), "hash2", "bytes", first.alias("first"))
    copies = named.join(copied, (F.col("hash") == F.col("hash_")) & (named["hash2"] == copied["hash2"]) & (named["bytes"] == copied["bytes"])).where(~F.col("key").eqNullSafe(F.col("first"))).select(*_doc(), "hash", F.lit(True).alias("copy")).distinct()
    copies = scratch.keep(copies, "copies")
    bits = int(longest or 1).bit_length()
    low = low or 0
    packs = not named_twice and (int(high or 0) - low + 2).bit_length() + bits <= 62 and copies.groupBy("doc", "named").count().where("count > 1").isEmpty()

    # A place is a document and a word; places are in the order of keys, nulls first, then of the texts' hashes, then of words.
    if packs:
        place = F.shiftleft(F.coalesce(F.col("key") - F.lit(low) + 1, F.lit(0)).cast("long"), bits).bitwiseOR(F.col("at"))
        unpack = [F.when(F.shiftright("place", bits) == 0, None).otherwise(F.shiftright("place", bits) - 1 + F.lit(low)).alias("key"), F.col("place").bitwiseAND((1 << bits) - 1).alias("at")]
        on = ["key"]
    else:
        place = F.struct("key", "hash", "at")
        unpack = [F.col("place.key").alias("key"), F.col("place.hash").alias("hash"), F.col("place.at").alias("at")]
        on = ["key", "hash"]
    match = ["doc", "named", *on[1:]]
    copies = copies.select("doc", "named", "hash", "copy")

    def join_up(tables: list[tuple[str, DataFrame]], carry: Sequence[Column] = ()) -> DataFrame:
        carried = [f"carried{k}" for k in range(len(carry))]
        held = docs.select(*own, *[c.alias(n) for c, n in zip(carry, carried, strict=True)]) if carry else base
        texts = held.select(*_doc(), "hash", "key", "text", *carried)
        # All joins have the same columns, so that texts are dealt once.
        out = texts.join(copies, match, "left") if len(match) > 2 else texts.join(copies.withColumnRenamed("hash", "hash_c"), match, "left")
        if len(match) == 2:
            out = out.withColumn("copy", F.col("copy") & (F.col("hash") == F.col("hash_c"))).drop("hash_c")
        for _, table in tables:
            out = out.join(table, match, "left")
        return out.select("key", "hash", "text", F.coalesce("copy", F.lit(False)).alias("copy"), *[name for name, _ in tables], *carried)

    def back(found: DataFrame, name: str) -> DataFrame:
        """Places, gathered by document: as many as the document's words at most."""
        rows = found.select(*unpack).select("*", *_doc())
        return rows.groupBy(*match).agg(F.collect_list(F.col("at").cast("int")).alias(name))

    def emit(level: int):
        final = level == len(sizes) - 1

        def parts(batches):
            kept_by_worker("windows")
            for batch in slices(batches):
                keys, hashes_of = batch.column(0), batch.column(1)
                took, where, one, two = [], [], [], []
                for k, (text, copy, gone) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _levels_of(batch, 4), strict=True)):
                    words = words_of(text)
                    if copy or len(words) < window:
                        continue
                    hashes = word_hashes(words)
                    places = np.unique(follow(hashes, sizes, gone)[1])
                    if not len(places):
                        continue
                    took.append(np.full(len(places), k))
                    where.append(places)
                    one.append(window_hashes(hashes, sizes[level])[places])
                    if final:
                        two.append(window_hashes(hashes, sizes[level], 1)[places])
                join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
                took = pa.array(join(took, np.int64))
                columns = [keys.take(took), hashes_of.take(took), pa.array(join(where, np.int64)), pa.array(join(one, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(join(two, np.uint64).view(np.int64))] if final else []), names=["key", "hash", "at", "w", "w2"][: len(columns) + final])

        return parts

    gone: list[tuple[str, DataFrame]] = []
    for level in range(len(sizes)):
        final = level == len(sizes) - 1
        rows = join_up(gone) if gone else base.select("key", "hash", "text", F.lit(False).alias("copy"))
        rows = rows.mapInArrow(emit(level), "key long, hash long, at long, w long" + ", w2 long" * final)
        name = "firsts" if final else f"gone{level}"
        counts = rows.groupBy("w", *["w2"] * final).agg(F.min(place).alias("place"), *([] if final else [F.count(F.lit(1)).alias("n")]))
        once = counts if final else counts.where("n = 1")
        gone.append((name, scratch.keep(back(once, name), name)))
        del rows, counts, once
        scratch.release()
    return join_up(gone, carry), sizes


def _removed_words(words: list[bytes], copy: bool, places: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Whether each word is to be removed."""
    window = sizes[-1]
    if len(words) < window:
        return np.zeros(len(words), bool)
    if copy:
        return np.ones(len(words), bool)
    *gone, firsts = places
    starts, _ = follow(word_hashes(words), sizes, gone)
    starts = starts[~np.isin(starts, firsts)]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def digests(docs: DataFrame, **options) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document; see removals() for the options.

    Null and empty texts have no words.  Rows of equal key and equal text are one place, so neither is removed
    for the other; rows of equal key and different texts stand in the order of a hash of the text.
    Null keys come before all others.  Other columns are not read.
    """
    rows, sizes = removals(docs, **options)

    def work(batches):
        kept_by_worker("digests")
        for batch in slices(batches):
            out = []
            for text, copy, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _levels_of(batch, 4), strict=True):
                words = words_of(text)
                removed = _removed_words(words, copy, places, sizes)
                kept = [w for w, x in zip(words, removed.tolist(), strict=True) if not x] if removed.any() else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(work, "key long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """The documents with repeated passages cut out of their texts; those that lose every word go.

    A text that loses no word stays as it is; of another, the kept words are joined by one
    space, and the column named by length, if there is one, is set to its new length.  Null and empty texts, and those
    shorter than a window, stay as they are.  Null keys come before all others; rows of equal key stand in the order of
    a hash of their text, and equal rows are one place, so neither is cut for the other.  Texts of any length are taken whole.
    An empty table gives none.  Keys must be whole numbers (TypeError).  All other columns are carried along as they are.
    """
    names, types = docs.columns, [f.dataType for f in docs.schema.fields]
    others = [k for k, c in enumerate(names) if c != text]
    rows, sizes = removals(docs, key=key, text=text, carry=[F.col(f"`{names[k]}`") for k in others], **options)
    first = 4 + len(sizes)

    def work(batches):
        kept_by_worker("cuts")
        for batch in slices(batches):
            texts, stays, lengths = [], [], {}
            for i, (value, copy, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _levels_of(batch, 4, len(sizes)), strict=True)):
                words = words_of(value)
                removed = _removed_words(words, copy, places, sizes)
                if removed.any():
                    value = b" ".join([w for w, x in zip(words, removed.tolist(), strict=True) if not x]).decode("utf-8", "surrogatepass")
                    lengths[i] = len(value)
                stays.append(i not in lengths or value != "")
                texts.append(value)
            columns: list[pa.Array] = [None] * len(names)
            columns[names.index(text)] = pa.array(texts, pa.string())
            for at, k in enumerate(others):
                columns[k] = batch.column(first + at)
                if names[k] == length and lengths:
                    columns[k] = pa.array([lengths.get(i, x) for i, x in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))]).filter(pa.array(stays, pa.bool_()))

    out = rows.mapInArrow(work, T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(types)]))
    return out.toDF(*names)
