"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction, and a vector passes it if their cosine reaches a bound: it
lies in a cap.  (A vector that reaches it seldom passes its best few filters instead.)  The directions are a product code: the coordinates, randomly rotated,
are cut into parts, each part has a code of random unit vectors, and a direction takes
one code word from each part.  So the filters that a vector passes are list-decoded from
a few inner products with the code words of each part, largest first, without looking at the
other combinations.  Vectors that pass a common filter are compared exactly, in double
precision.

Equal vectors are one class from the start, so copies are never compared.  A filter that many
vectors pass is cut into blocks whose pairs go to different tasks.  A pair that meets in
several filters counts in the smallest one.  Links are not written out: a task returns
how many each vector has, and edges enough to connect what is linked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, integral_key, kept_by_worker, slices
from .components import Forest, components, link_rows

COSINE = 0.95
#: Filters that a random vector passes on average, and the fewest that any vector passes: its best ones, if it reaches the bound in fewer.
#: The more directions there are, the more of their best two near vectors need to have one in common: two more for each doubling
#: beyond FEW_DIRECTIONS. Recall of pairs of 64 dimensions at a cosine of 0.951, measured: 0.999 with two parts of 57 words, 0.999 of 512, 0.998
#: of 2048, 0.999 of 4096, 0.99 with three parts of 512.
LIST, LEAST, FEW_DIRECTIONS = 16, 12, 57**2
#: Vectors that share a filter, on average; the number of directions follows from it and the number of vectors. They are
#: pairs of code words, or triples where pairs would take more than MOST_WORDS words of a part.
BUCKET, FEWEST_WORDS, MOST_WORDS = 256, 32, 4096
#: Inner products with the code words of a part that a task holds at a time.
HELD = 1 << 20
SEED = 7
#: Vectors in a block, about.
BLOCK = 1024
#: So many crowded filters are sent to every task; more are joined.
SENT_FILTERS = 50_000

NO_LINKS = pa.table({k: pa.array([], pa.int64()) for k in "abn"})


@dataclass
class CapCode:
    """Directions: rotation, then code words (unit vectors) of each part; a direction is their join divided by the root of the parts."""

    rotation: np.ndarray
    words: list[np.ndarray]
    bound: float
    least: int = 1

    @classmethod
    def for_vectors(cls, vectors: int, dimensions: int, *, average_list: float = LIST, least: int | None = None, seed: int = SEED) -> CapCode:
        """A code whose size follows from the number of vectors: BUCKET of them share a filter on average, however many there are."""
        directions = vectors * average_list / BUCKET
        parts = max(1, min(dimensions // 2, 2 if directions <= MOST_WORDS**2 else 3))  # of one dimension, code words would be alike
        # Vectors of fewer than four dimensions have one part, which is bounded: there, buckets grow with the table.
        words = int(min(MOST_WORDS if parts == 1 else np.inf, max(FEWEST_WORDS, directions ** (1 / parts) + 1)))
        return cls.build(dimensions, code_words=words, parts=parts, average_list=average_list, least=least, seed=seed)

    @classmethod
    def build(cls, dimensions: int, *, code_words: int, parts: int = 2, average_list: float = LIST, least: int | None = None, seed: int = SEED) -> CapCode:
        """The bound is such that a random vector passes average_list filters on average (measured on random vectors drawn from the seed)."""
        rng = np.random.default_rng(seed)
        parts = max(1, min(parts, dimensions // 2))
        rotation = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
        words = []
        for cut in np.array_split(np.arange(dimensions), parts):
            w = rng.standard_normal((code_words, len(cut)))
            words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(parts))
        probe = rng.standard_normal((512, dimensions))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        many = code_words ** len(words)
        least = least or int(np.ceil(LEAST + 2 * max(0.0, np.log2(many / FEW_DIRECTIONS))))
        # The list's length at a bound is the share of all sums above it, and the sums above any bound come from the largest partial ones.
        empty = cls(rotation, words, 0.0)
        best = np.concatenate([empty._best(probe[k : k + 32], min(many, 8 * int(average_list) + 64)) for k in range(0, len(probe), 32)])
        return cls(rotation, words, float(np.sort(best, axis=None)[::-1][min(best.size - 1, int(512 * min(average_list, many)))]), min(least, many))

    def _best(self, turned: np.ndarray, n: int) -> np.ndarray:
        """The n largest sums of each vector, one code word from each part; unordered."""
        sums, at = np.zeros((len(turned), 1)), 0
        for w in self.words:
            got = turned[:, at : at + w.shape[1]] @ w.T
            at += w.shape[1]
            got = -np.partition(-got, min(n, got.shape[1]) - 1, axis=1)[:, :n]
            sums = (sums[:, :, None] + got[:, None, :]).reshape(len(turned), -1)
            sums = -np.partition(-sums, min(n, sums.shape[1]) - 1, axis=1)[:, :n]
        return sums

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a vector, filter) for every filter that each of the unit vectors passes; so many vectors at a time that memory has a bound."""
        step = max(1, HELD // max(len(w) for w in self.words))
        found = [self._decode(unit[k : k + step]) for k in range(0, len(unit), step)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([who + k * step for k, (who, _) in enumerate(found)]), np.concatenate([number for _, number in found])

    def _decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        tops, orders, at = [], [], 0
        for w in self.words:
            got = turned[:, at : at + w.shape[1]] @ w.T
            at += w.shape[1]
            order = np.argsort(-got, axis=1, kind="stable")
            orders.append(order)
            tops.append(np.take_along_axis(got, order, 1))
        bound = np.minimum(self.bound, self._best(turned, self.least).min(1))
        rest = np.concatenate([np.cumsum([t[:, 0] for t in tops[::-1]], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
        who, total, number = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for part, (top, order) in enumerate(zip(tops, orders, strict=True)):
            # Code words in falling order: as soon as one cannot reach the bound with the best of what follows, none after it can.
            need = bound[who] - total - rest[part][who] - 1e-12
            counts = (top[who] >= need[:, None]).sum(1)
            grown = np.repeat(np.arange(len(who)), counts)
            place = np.arange(len(grown)) - np.repeat(np.cumsum(counts) - counts, counts)
            number = number[grown] * top.shape[1] + order[who[grown], place]
            total = total[grown] + top[who[grown], place]
            who = who[grown]
        return who, number


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimensions)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and has finite components only."""
    finite = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, code_words: int | None = None, parts: int = 2, average_list: float = LIST, least: int | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component, kept) of every row.

    n_links counts the other rows found at a cosine of at least cosine; component is the
    smallest key reachable over such links.  A vector that is null, empty or zero, or that holds null or
    non-finite components, links with nothing, and so does one whose number of dimensions differs.
    A null key is never a component's name; a row that links with no named one has its own key.
    Rows of equal key are one node in components, and others to each other in n_links; equal vectors link with each
    other.  An empty table gives none.  Keys must be whole numbers (TypeError).  Without code_words (and then parts), the code's size follows
    from the number of vectors.  Labels and other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    rows = vectors.select(integral_key(vectors, key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    good = usable(rows, "vector")
    # -0.0 and 0.0 are the same component. A class is known by a hash of its vector, and kept apart by the vector itself.
    classes = good.select("key", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).groupBy("vector").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("class"), "vector", "id", "copies"), "classes")
    counts = {r.size: r.n for r in classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for dimensions in sorted(counts):  # vectors of one length are compared with each other only
        options = {"average_list": average_list, "least": least, "seed": seed}
        code = CapCode.build(dimensions, code_words=code_words, parts=parts, **options) if code_words else CapCode.for_vectors(counts[dimensions], dimensions, **options)
        part = _links(classes.where(F.size("vector") == dimensions), dimensions, scratch, cosine, code, block, np.float32 if narrow else np.float64)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("kept"))
    found = scratch.keep(found, "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    # A component of classes is named after the smallest id in it.
    named = classes.select("class", "id", "copies").join(linked, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("component", "class")).drop("node", "component")
    names = named.groupBy("group").agg(F.min("id").alias("component"))
    out = scratch.keep(named.join(names, "group").join(links, "class", "left").select("class", "component", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "classes-out")
    vectors_of = classes.select("class", F.col("vector").alias("vector_"))
    told = out.join(vectors_of, "class").drop("class")
    clean = F.transform("vector", lambda x: x + F.lit(0.0))
    joined = rows.join(told, clean == F.col("vector_"), "left")
    component = F.coalesce("component", "key")
    return joined.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(classes: DataFrame, dimensions: int, scratch: Scratch, cosine: float, code: CapCode, block: int, kind: type) -> DataFrame:
    """(a, b, n): n links of class a where b is null; an edge between classes a and b where it is not."""

    def decode(batches):
        kept_by_worker("caps")
        for batch in slices(batches, 2048):
            x = _matrix(batch.column(2), dimensions)
            who, number = code.decode(_units(x))
            order = np.lexsort((number, who))
            who, number = who[order], number[order]
            cuts = np.searchsorted(who, np.arange(len(x) + 1)).astype(np.int32)
            filters = pa.ListArray.from_arrays(pa.array(cuts), pa.array(number))
            raw = [row.tobytes() for row in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), filters], names=["class", "copies", "raw", "filters"])

    decoded = scratch.keep(classes.select("class", "copies", "vector").mapInArrow(decode, "class long, copies long, raw binary, filters array<long>"), "decoded")
    crowded = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks")).where("blocks > 1")
    crowded = scratch.keep(crowded, "crowded")
    if crowded.limit(SENT_FILTERS + 1).count() <= SENT_FILTERS:
        crowded = F.broadcast(crowded)
    dealt = decoded.select("*", F.explode("filters").alias("filter")).join(crowded, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Each vector goes to the pairs of blocks that hold its own; the pairs of a filter are told apart by their two blocks.
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    smaller = F.filter("filters", lambda f: f < F.col("filter"))
    sent = dealt.select("filter", "block", "class", "copies", "raw", smaller.alias("smaller"), meets.alias("m")).select("filter", "m.i", "m.j", "block", "class", "copies", "raw", "smaller")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        _, i, j, sides, ids, copies, raw, smaller = (c.chunk(0) for c in table.columns)
        i, j = i[0].as_py(), j[0].as_py()
        sides, ids, copies = sides.to_numpy(), ids.to_numpy(), copies.to_numpy().astype(float)
        if len(ids) < 2:
            return NO_LINKS
        unit = _units(np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dimensions).astype(float))
        left, right = (np.flatnonzero(sides == k) for k in (i, j))
        forest, n, shared = Forest(), np.zeros(len(ids)), None
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            hits = unit[rows] @ unit[right].T >= cosine
            if i == j:
                hits &= rows[:, None] < right
            if hits.any():
                if shared is None:  # incidence of smaller filters: a pair that shares one is counted there
                    owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(smaller.offsets)))
                    names, slot = np.unique(np.asarray(smaller.flatten()), return_inverse=True)
                    shared = np.zeros((len(ids), len(names)), np.float32)
                    shared[owner, slot] = 1
                link_rows(forest, ids[rows], ids[right], hits)
                first = (hits & (shared[rows] @ shared[right].T == 0)).astype(float)
                n[rows] += first @ copies[right]
                n[right] += first.T @ copies[rows]
        some = np.flatnonzero(n)
        x, y = forest.edges()
        ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(y, pa.int64())])
        return pa.table({"a": pa.array(np.concatenate([ids[some], x]), pa.int64()), "b": ends, "n": pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(x), np.int64)]), pa.int64())})

    return sent.groupBy("filter", "i", "j").applyInArrow(compare, "a long, b long, n long")
