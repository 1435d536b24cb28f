"""The order of a heat map's columns: as given, by the state in which each weighs most, or by hierarchical clustering.

Clustering is for what fits on a page: up to MOST columns come to the driver, which is checked, and beyond that the order is the given one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that are clustered, at most.
MOST = 4000


def ward_linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of the rows of x by Ward's criterion, lowest first, a < b; the k-th merge is node len(x) + k.

    By chains of nearest neighbours: a pair of nodes that are each other's nearest is merged, in whatever order the chain meets them, and the merges are
    sorted by height afterwards. Of equally near nodes the one before in the chain is the nearest, else the first.
    """
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2).astype(float)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, met = np.ones(n), np.ones(n, bool), [], []
    while len(met) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            near = np.where(alive, d[a], np.inf)
            b = int(near.argmin())
            if len(chain) > 1 and near[chain[-2]] <= near[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        met.append((a, b, d[a, b]))
        # The merged node stays in b's place (Lance and Williams's update).
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        alive[a] = False
        size[b] += size[a]
        d[b] = d[:, b] = np.where(alive, new, np.inf)
        d[b, b] = np.inf
    names, out, top = {}, [], list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (a, b, height) in enumerate(sorted(met, key=lambda m: m[2])):
        a, b = root(a), root(b)
        first, second = sorted((names.get(a, a), names.get(b, b)))
        out.append((first, second, float(np.sqrt(height))))
        top[a] = b
        names[b] = n + k
    return out


def leaves(merges: Sequence[tuple[int, int, float]], n: int) -> list[int]:
    """The rows in the order of the tree: of each merge the lower node first."""
    todo, out = [n + len(merges) - 1] if merges else list(range(n)), []
    while todo:
        node = todo.pop()
        if node < n:
            out.append(node)
        else:
            todo += [merges[node - n][1], merges[node - n][0]]
    return out


def ordered_columns(table: DataFrame, states: Sequence[str], *, mode: str = "clustered", gene: str = "gene", state: str = "state", value: str = "value", place: str | None = None, most: int = MOST) -> DataFrame:
    """(gene, place) from 1 on, of a table (state, gene, value) with one row at most for each; what is not there is 0.

    mode is input (by the column place, or by name), max_state (by the state of the largest size, the earliest of equals; then by that size and the value, largest first, then by
    name), or clustered (Ward's tree over the genes' values in all states). Two genes or fewer, and more than most where they are to be clustered, are in input order. An empty table gives none.
    """
    if mode not in ("input", "max_state", "clustered"):
        raise ValueError(f"mode is input, max_state or clustered, not {mode}")
    given = [F.min(place).alias("given")] if place else [F.lit(0).alias("given")]
    by_gene = table.groupBy(F.col(gene).alias("gene")).agg(*given, *[F.coalesce(F.max(F.when(F.col(state) == s, F.col(value))), F.lit(0.0)).cast("double").alias(f"v{k}") for k, s in enumerate(states)])
    order, few = [F.col("given"), F.col("gene")], by_gene.limit(most + 1).count()
    if mode == "max_state" and few > 2:
        tops = F.array(*[F.struct((-F.abs(f"v{k}")).alias("size"), F.lit(k).alias("state"), (-F.col(f"v{k}")).alias("signed")) for k in range(len(states))])
        top = F.array_min(tops)
        order = [top["state"], top["size"], top["signed"], F.col("gene")]
    if mode == "clustered" and 2 < few <= most:
        rows = by_gene.orderBy("given", "gene").collect()  # most at most
        x = np.array([[r[f"v{k}"] for k in range(len(states))] for r in rows], float)
        names = [rows[i].gene for i in leaves(ward_linkage(x), len(rows))]
        kind = f"{gene} {by_gene.schema['gene'].dataType.simpleString()}, place long"
        return table.sparkSession.createDataFrame([(g, k) for k, g in enumerate(names, 1)], kind)
    return by_gene.select(F.col("gene").alias(gene), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long").alias("place"))  # a heat map's columns
