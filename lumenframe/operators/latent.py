"""A latent space from expression: singular vectors of centred, log-normalised counts in long form.

The matrix is written once, a row for each cell with its entries above 0; centring is worked in by the genes' means, so no zero is ever
written.  A round reads the cells once: a task makes their rows of the thin matrix from the genes' columns, which are sent to it, and adds up what they give back to the genes, so what is
shuffled are sums by gene, whatever the number of cells.  Where the genes' columns are too many numbers to be sent, each half of a round is a join and a group by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..scratch import Scratch
from .graph import gram

#: Numbers of the genes' columns that are sent to every task; beyond, they are joined.
SENT = 4_000_000
#: Entries that a task works on at a time, about.
ENTRIES = 1 << 16


def _turned(rows: DataFrame, keep: Sequence[str], names: Sequence[str], turn: np.ndarray, to: Sequence[str]) -> DataFrame:
    return rows.select(*keep, *[sum((F.col(x) * float(turn[i, j]) for i, x in enumerate(names)), F.lit(0.0)).alias(y) for j, y in enumerate(to)])


def _projected(batches: Iterator[pa.RecordBatch], genes: pa.Array, columns: np.ndarray, shift: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(cells, their rows of the centred matrix times the genes' columns, and of each entry the number of the cell, that of the gene, and the value) of batches (cell, entries)."""
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], ENTRIES)[1:])).tolist() if len(ends) else []
        for start, stop in zip([0, *cuts], [*cuts, len(ends)], strict=True):
            lists = batch.column(1).slice(start, stop - start)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            at, x = pc.index_in(flat.field("gene"), value_set=genes).to_numpy(zero_copy_only=False), flat.field("x").to_numpy()
            y = np.tile(-shift, (len(sizes), 1))
            if len(x):
                some = np.flatnonzero(sizes)
                y[some] += np.add.reduceat(columns[at] * x[:, None], (np.cumsum(sizes) - sizes)[some])
            yield batch.column(0).slice(start, stop - start), y, np.repeat(np.arange(len(sizes)), sizes), at, x


def singular_vectors(entries: DataFrame, k: int, *, cell: str = "cell_id", gene: str = "gene", value: str = "x", cells: DataFrame | None = None, spare: int = 8, most: int = 40, tolerance: float = 1e-9, sent: int = SENT) -> tuple[DataFrame, DataFrame, list[float]]:
    """(scores (cell, c1 ... ck), loadings (gene, c1 ... ck), singular values) of the centred matrix of entries (cell, gene, value), by randomised subspace iteration.

    Entries that are not there, or null, are 0; there must be one at most for a cell and gene. cells are all cells, by default those of the entries; a cell without entries has a
    row, too. scores are left singular vectors times singular values; the loading of the largest size in each column (of equals the first gene's) is above 0. It ends when no singular value changes by
    tolerance of the largest, after most rounds at last; where the rank is below k there are as many columns as that. An empty table gives none. The genes' columns are sent to every task
    up to so many numbers.
    """
    scratch = Scratch(entries.sparkSession, "latent")
    there = F.col(cell).isNotNull() & F.col(gene).isNotNull() & F.col(value).isNotNull()
    entry = F.struct(F.col(gene).alias("gene"), F.col(value).cast("double").alias("x"))
    rows = entries.groupBy(F.col(cell).alias("cell")).agg(F.collect_list(F.when(there, entry)).alias("entries"))  # a gene once
    if cells is not None:
        rows = cells.select(F.col(cell).alias("cell")).distinct().join(rows, "cell", "left").select("cell", F.coalesce("entries", F.array().cast(rows.schema["entries"].dataType)).alias("entries"))
    rows = scratch.keep(rows, "rows")
    n = rows.count()
    x = rows.select("cell", F.explode("entries").alias("e")).select("cell", "e.gene", "e.x")
    means = scratch.keep(x.groupBy("gene").agg((F.sum("x") / F.lit(float(max(n, 1)))).alias("mean")), "means")
    m = means.count()
    names = [f"c{j}" for j in range(1, k + spare + 1)]
    noise = lambda j: F.pmod(F.xxhash64("gene", F.lit(j)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0
    genes = means.select("gene", *[noise(j).alias(c) for j, c in enumerate(names)])
    found = None
    if n and m:
        found = _by_sums(rows, means, genes, names, k, most, tolerance) if m * len(names) <= sent else _by_joins(scratch, rows.select("cell"), x, means, genes, names, k, most, tolerance)
    if found is None:
        return rows.select(F.col("cell").alias(cell)).where("false"), means.select(F.col("gene").alias(gene)).where("false"), []
    scores, loadings, names, values = found
    return _signed(scores, loadings, names, cell, gene, values)


def _by_sums(rows: DataFrame, means: DataFrame, genes: DataFrame, names: list[str], k: int, most: int, tolerance: float) -> tuple[DataFrame, DataFrame, list[str], list[float]] | None:
    """(scores, loadings, names of the columns, singular values); of genes in a number that the driver may hold."""
    session = rows.sparkSession
    first = means.join(genes, "gene").toArrow().sort_by("gene")
    ids, mean = first["gene"].combine_chunks(), first["mean"].to_numpy()
    g = np.stack([first[c].to_numpy() for c in names], 1)

    def summed(g: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """With y the cells' rows: a row for each gene of the matrix, turned over, times y; then y's products with itself, and its sum."""
        shared, p = session.sparkContext.broadcast((ids, g, shift)), g.shape[1]

        def work(batches):
            ids, g, shift = shared.value
            out, seen = np.zeros((len(g) + p + 1, p)), np.zeros(len(g) + p + 1, bool)
            for _, y, of, at, x in _projected(batches, ids, g, shift):
                out[len(g) : -1] += y.T @ y
                out[-1] += y.sum(0)
                seen[len(g) :] = seen[at] = True
                for j in range(p):
                    sums = np.bincount(at, x * y[of, j])
                    out[: len(sums), j] += sums
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c) for c in out[at].T]], names=["number", *names[:p]])

        sums = rows.mapInArrow(work, "number long, " + ", ".join(f"{c} double" for c in names[:p])).groupBy("number").agg(*[F.sum(c).alias(c) for c in names[:p]]).toArrow()
        out = np.zeros((len(g) + p + 1, p))
        out[sums["number"].to_numpy()] = np.stack([sums[c].to_numpy() for c in names[:p]], 1)
        shared.destroy()
        return out

    values = np.zeros(len(names))
    for _ in range(most):
        shift, before = mean @ g, g
        sums = summed(g, shift)
        turn = _orthonormal_turn(sums[len(g) : -1])
        if not turn.shape[1]:
            return None
        right = (sums[: len(g)] - np.outer(mean, sums[-1])) @ turn
        values, more, change = _ritz(right.T @ right, values, k)
        g, held = right @ more / values, before @ (turn @ more)
        if not len(values) or change <= tolerance * values[0]:
            break
    if not len(values):
        return None
    names, values = names[: min(k, len(values))], values[:k]
    shared = session.sparkContext.broadcast((ids, held[:, :k] * values, (mean @ held)[:k] * values))

    def work(batches):
        for cell, y, *_ in _projected(batches, *shared.value):
            yield pa.RecordBatch.from_arrays([cell, *[pa.array(c) for c in y.T]], names=["cell", *names])

    scores = rows.mapInArrow(work, StructType([rows.schema["cell"], *[StructField(c, DoubleType()) for c in names]]))
    loadings = session.createDataFrame(pa.table([ids, *[pa.array(c) for c in g[:, :k].T]], names=["gene", *names]))
    return scores, loadings, names, [float(v) for v in values]


def _orthonormal_turn(products: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; columns that the others span are left out."""
    scale, turn = np.linalg.eigh(products)
    keep = scale > 1e-12 * max(scale.max(), 1e-300)
    return (turn[:, keep] / np.sqrt(scale[keep]))[:, ::-1]


def _ritz(products: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(singular values that are not 0, their vectors in the space of the columns, the largest change of the first k) of columns with these products."""
    squares, turn = np.linalg.eigh(products)
    found = np.sqrt(np.maximum(squares[::-1], 0.0))
    change = np.abs(found[:k] - before[: len(found)][:k]).max() if len(before) >= len(found) else np.inf
    good = found > 1e-9 * max(found[0], 1e-300)
    return found[good], turn[:, ::-1][:, good], change


def _by_joins(scratch: Scratch, every: DataFrame, x: DataFrame, means: DataFrame, genes: DataFrame, names: list[str], k: int, most: int, tolerance: float) -> tuple[DataFrame, DataFrame, list[str], list[float]] | None:
    """(scores, loadings, names of the columns, singular values)."""

    def to_cells(genes: DataFrame) -> DataFrame:
        """The centred matrix times the genes' columns."""
        shift = genes.join(means, "gene").agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in names]).first()
        come = x.join(genes, "gene").groupBy("cell").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in names])
        return every.join(come, "cell", "left").select("cell", *[(F.coalesce(c, F.lit(0.0)) - float(shift[c] or 0.0)).alias(c) for c in names])

    def to_genes(cells: DataFrame) -> DataFrame:
        """The centred matrix, turned over, times the cells' columns."""
        sums = cells.agg(*[F.sum(c).alias(c) for c in names]).first()
        come = x.join(cells, "cell").groupBy("gene").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in names])
        return come.join(means, "gene").select("gene", *[(F.col(c) - F.col("mean") * float(sums[c] or 0.0)).alias(c) for c in names])

    values = np.zeros(len(names))
    for _ in range(most):
        cells = scratch.keep(to_cells(genes), "cells")
        turn = _orthonormal_turn(gram(cells, names))
        left, names = _turned(cells, ["cell"], names, turn, names[: turn.shape[1]]), names[: turn.shape[1]]
        if not names:
            return None
        right = scratch.keep(to_genes(left), "right")
        values, more, change = _ritz(gram(right, names), values, k)
        # The next columns are the right singular vectors so far.
        names, old = names[: len(values)], names
        genes = _turned(right, ["gene"], old, more / values, names)
        scores = _turned(left, ["cell"], old, more, names)
        if not names or change <= tolerance * values[0]:
            break
    if not names:
        return None
    names = names[:k]
    scores = scores.select("cell", *[(F.col(c) * float(v)).alias(c) for c, v in zip(names, values, strict=False)])
    return scores, genes, names, [float(v) for v in values[:k]]


def _signed(scores: DataFrame, loadings: DataFrame, names: list[str], cell: str, gene: str, values: list[float]) -> tuple[DataFrame, DataFrame, list[float]]:
    tops = loadings.agg(*[F.max(F.round(F.abs(c), 9)).alias(c) for c in names]).first()
    first = loadings.agg(*[F.min_by(F.signum(c), F.when(F.round(F.abs(c), 9) == tops[c], F.col("gene"))).alias(c) for c in names]).first()
    turned = lambda rows, key, name: rows.select(F.col(key).alias(name), *[(F.col(c) * float(first[c] or 1.0)).alias(c) for c in names])
    return turned(scores, "cell", cell), turned(loadings, "gene", gene), values
