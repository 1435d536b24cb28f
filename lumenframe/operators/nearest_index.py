"""Nearest neighbours over whole tables, by a partitioned inverted file.

Centres are fitted by Spark on a bounded sample, and every point belongs to the cell of its nearest one.  A point looks into the cells
whose centres are nearest (its probe list); in exact mode into every cell that the triangle inequality does not rule out, given the
distance of the last neighbour found so far.  Points are written once, in files of blocks of bounded size of one cell.  A task takes the points of a file and
reads the other files block by block, those of near cells first, so no vector is sent twice whatever the number of cells; what is exact is quadratic in time where nothing can be ruled out,
but not in what is written.  Blocks are compared in numpy: candidates by the fast form of the distance, their order by exact differences.

Equal vectors are one vector with the smallest keys of its rows, as no more of them can be among the neighbours.  No
point is sent to every task: centres are, and their number is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Cells at most: their centres are sent to every task.
MOST_CELLS = 4096
#: Sampled points for each centre.
SAMPLE = 64
#: Points of a block, at most.
BLOCK = 2048
#: Points that a task looks for the neighbours of at a time, at most about; a file holds no more.
ROWS = 8192
#: Cells that a point looks into first.
PROBES = 8


@dataclass
class Cells:
    """Centres, and the number of points and the distance of the farthest one in each cell."""

    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0.0))


def usable(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of rows with a key and a vector of finite numbers; the others have no neighbours and are no one's."""
    v = F.col(vector).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size(v) > 0)
    # Zeros of either sign are equal.
    return points.where(F.col(key).isNotNull() & finite).select(F.col(key).cast("long").alias("key"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vector"))


def fit_centres(vectors: DataFrame, n: int, *, most_cells: int = MOST_CELLS, seed: int = 0) -> np.ndarray:
    """Centres, about the root of the number of vectors, of a sample by a hash of the vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = max(1, min(most_cells, math.isqrt(n)))
    share = min(1.0, SAMPLE * cells / max(1, n))
    sample = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(array_to_vector("vector").alias("features"))
    if cells == 1 or sample.limit(cells).count() < cells:
        first = vectors.orderBy(F.xxhash64("vector"), "vector").limit(cells).select("vector").collect()
        return np.array([r.vector for r in first], float)
    return np.array(KMeans(k=cells, maxIter=8, seed=seed, initMode="random").fit(sample).clusterCenters(), float)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _assigned(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell, away, probes): the nearest cell, the distance to its centre, and the probe list."""
    shared = vectors.sparkSession.sparkContext.broadcast(Cells(centres, np.zeros(0), np.zeros(0)))

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                d = shared.value.distances(_matrix(part.column(1)))
                n = min(probes, d.shape[1])
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * n, pa.int32()), pa.array(near.reshape(-1), pa.int32()))
                away = d[np.arange(len(d)), near[:, 0]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near[:, 0], pa.int32()), pa.array(away), lists], names=["id", "vector", "cell", "away", "probes"])

    return vectors.select("id", "vector").mapInArrow(work, "id long, vector array<double>, cell int, away double, probes array<int>")


def _written(cells: DataFrame, n: int, block: int, scratch: Scratch) -> DataFrame:
    """(cell, ids, vectors, probes): blocks of points of one cell as bytes, in files of neighbouring cells; a crowded cell is in several."""

    def pack(batches):
        for batch in batches:
            cell = batch.column(2).to_numpy()
            ids, x, probes = batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(3)).astype(np.int32)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            cuts = [(a, min(a + block, end)) for start, end in zip(starts, starts[1:], strict=False) for a in range(start, end, block)]
            kinds = ((ids, pa.binary()), (x, pa.binary()), (probes, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([int(cell[a]) for a, _ in cuts], pa.int32()), *[pa.array([v[a:b].tobytes() for a, b in cuts], kind) for v, kind in kinds]], names=["cell", "ids", "vectors", "probes"])

    files = max(1, min(64, n // 256), -(-n // ROWS))
    dealt = cells.select("id", "vector", "cell", "probes", F.xxhash64("id").alias("place")).repartitionByRange(files, "cell", "place").sortWithinPartitions("cell", "place")
    return scratch.keep(dealt.drop("place").mapInArrow(pack, "cell int, ids binary, vectors binary, probes binary"), "blocks")


def _opened(file: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, ids, vectors, probes) of each block of a file."""
    system, at = fs.FileSystem.from_uri(file)
    with system.open_input_file(at) as held:
        for batch in pq.ParquetFile(held).iter_batches(batch_size=1):
            for i in range(batch.num_rows):
                ids, x, probes = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, np.int64), (2, np.float64), (3, np.int32)))
                yield batch.column(0)[i].as_py(), ids, x.reshape(len(ids), -1), probes.reshape(len(ids), -1)


class Nearest:
    """The k nearest so far of queries, in order of distance and id, padded by infinity."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.squares = (q * q).sum(1)
        self.wide = np.concatenate([-2 * q, self.squares[:, None], np.ones((len(q), 1))], 1)
        self.d, self.ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def distances(self, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares + centre @ centre - 2 * (self.q @ centre), 0.0))

    def look(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Compare the queries in rows with the points x."""
        squares = (x * x).sum(1)
        wide = np.concatenate([x, np.ones((len(x), 1)), squares[:, None]], 1).T
        for a in range(0, len(rows), 256):
            self._look(rows[a : a + 256], x, ids, wide, squares.max(initial=0.0))

    def _look(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, wide: np.ndarray, largest: float) -> None:
        rough = self.wide[rows] @ wide
        cut = self.d[rows, -1] ** 2
        short = np.flatnonzero(np.isinf(cut))
        if len(short) and len(x) > self.k:
            cut[short] = np.partition(rough[short], self.k - 1, axis=1)[:, self.k - 1]
        # Candidates by the fast form, with room for its rounding.
        row, at = np.nonzero(rough <= (cut + 1e-9 * (self.squares[rows] + largest) + 1e-12)[:, None])
        if not len(row):
            return
        d = np.concatenate([np.sqrt(((x[at[s : s + 65536]] - self.q[rows[row[s : s + 65536]]]) ** 2).sum(1)) for s in range(0, len(at), 65536)])
        some = np.unique(row)
        changed = rows[some]
        row, d, found = np.concatenate([row, np.repeat(some, self.k)]), np.concatenate([d, self.d[changed].reshape(-1)]), np.concatenate([ids[at], self.ids[changed].reshape(-1)])
        order = np.lexsort((found, d, row))
        # A query has k entries at least, as the padding counts.
        first = order[np.searchsorted(row[order], some)[:, None] + np.arange(self.k)]
        self.d[changed], self.ids[changed] = d[first], found[first]


def _searched(ids: np.ndarray, q: np.ndarray, probes: np.ndarray, files: list[tuple[str, np.ndarray]], known: Cells, k: int, exact: bool) -> pa.RecordBatch:
    """(id, found): the k nearest of queries, as structs (d, id), from the files (name, cells) that may hold some."""
    near = Nearest(q, k)

    def looking(cell: int) -> np.ndarray:
        if not exact:
            return np.flatnonzero((probes == cell).any(1))
        d = near.distances(known.centres[cell])
        bound = near.d[:, -1]
        return np.flatnonzero(d - known.radii[cell] <= bound * (1 + 1e-9) + 1e-6 * (1 + d))

    middle = known.distances(q.mean(0)[None])[0]
    for file, cells in sorted(files, key=lambda f: (middle[f[1]].min(), f[0])):
        if any(len(looking(c)) for c in cells):
            for cell, theirs, x, _ in _opened(file):
                if len(rows := looking(cell)):
                    near.look(rows, x, theirs)
    there = np.isfinite(near.d)
    ends = np.concatenate([[0], np.cumsum(there.sum(1))])
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(near.d[there]), pa.array(near.ids[there])], names=["d", "id"]))
    return pa.RecordBatch.from_arrays([pa.array(ids), found], names=["id", "found"])


def _compared(blocks: DataFrame, known: Cells, k: int, exact: bool) -> DataFrame:
    """(id, found) of all points of written blocks: a task for each file, which opens the others itself."""
    listed = blocks.select(F.col("_metadata.file_path").alias("file"), "cell").groupBy("file").agg(F.collect_set("cell").alias("cells")).collect()  # a row for each file
    session = blocks.sparkSession
    shared = session.sparkContext.broadcast((known, [(r.file, np.array(sorted(r.cells))) for r in sorted(listed, key=lambda r: r.file)]))

    def work(batches):
        known, files = shared.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                taken, rows = [], 0
                for _, *block in _opened(files[number][0]):
                    taken.append(block)
                    rows += len(block[0])
                    if rows >= ROWS:
                        yield _searched(*map(np.concatenate, zip(*taken, strict=True)), files, known, k, exact)
                        taken, rows = [], 0
                if taken:
                    yield _searched(*map(np.concatenate, zip(*taken, strict=True)), files, known, k, exact)

    return session.range(0, len(listed), 1, len(listed)).mapInArrow(work, "id long, found array<struct<d:double,id:long>>")


def nearest_of_all(points: DataFrame, k: int, *, key: str = "id", vector: str = "z", exact: bool = True, probes: int = PROBES, most_cells: int = MOST_CELLS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(key, neighbour, rank, distance) of the k nearest other points of each, of equals the smaller key first.

    exact looks wherever a neighbour may be; else only into the cells of the probe list, and some neighbours may be others'. Rows whose key or vector is null, or
    that hold null or non-finite numbers, have no neighbours and are none. Keys are whole numbers and must differ. A point is left out by its key, so equal vectors are
    neighbours. An empty table, or one of one point, gives none.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    rows = scratch.keep(usable(points, key, vector), "points")
    # Equal vectors meet here: no more than k + 1 rows of each are sent on by a task.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    vectors = scratch.keep(members.groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("id", F.col("keys")[0]), "vectors")
    n = vectors.count()
    out = points.sparkSession.createDataFrame([], f"{key} long, neighbour long, rank long, distance double")
    if not n or rows.limit(2).count() < 2:
        return out
    centres = fit_centres(vectors, n, most_cells=most_cells, seed=seed)
    cells = scratch.keep(_assigned(vectors, centres, probes), "cells")
    stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))
    stats = scratch.keep(stats, "sizes")
    counts, radii = np.zeros(len(centres)), np.full(len(centres), -np.inf)
    for r in stats.collect():  # a row for each cell
        counts[r.cell], radii[r.cell] = r.rows, r.radius
    blocks = _written(cells, n, block, scratch)
    scratch.drop(cells)
    found = scratch.keep(_compared(blocks, Cells(centres, counts, radii), k + 1, exact), "found")
    scratch.drop(blocks)
    # From vectors back to rows: each vector stands for its smallest keys.
    several = vectors.where(F.size("keys") > 1).select(F.col("id").alias("id_"), "keys")
    if several.isEmpty():
        near = found.withColumnRenamed("id", "key")
    else:
        each = found.select("id", F.explode("found").alias("f")).select("id", F.col("f.d").alias("d"), F.col("f.id").alias("other"))
        each = each.join(several, F.col("other") == F.col("id_"), "left").select("id", "d", F.explode(F.coalesce("keys", F.array("other"))).alias("other"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
        each = each.withColumn("place", place).where(F.col("place") <= k + 1)
        lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", F.col("other").alias("id")))).alias("found"))
        named = vectors.join(lists, "id").select(F.col("vector").alias("vector_"), "found")
        near = rows.join(named, F.col("vector") == F.col("vector_")).select("key", "found")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("key")), 1, k)
    near = near.select("key", F.posexplode(others).alias("rank", "f"))
    return near.select(F.col("key").alias(key), F.col("f.id").alias("neighbour"), (F.col("rank") + 1).cast("long").alias("rank"), F.col("f.d").alias("distance"))


def recall(found: DataFrame, true: DataFrame, *, key: str = "id") -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    same = found.select(key, "neighbour", F.lit(1).alias("hit"))
    return true.join(same, [key, "neighbour"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
