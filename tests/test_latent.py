import numpy as np
import pytest

from lumenframe.operators import latent


def matrix(n=60, m=25, seed=2):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(0.6 + 4 * np.outer(rng.random(n) < 0.4, rng.random(m) < 0.3) + 3 * np.outer(rng.random(n) < 0.5, rng.random(m) < 0.2))
    counts[7] = 0  # a cell without entries
    return np.log1p(counts / np.maximum(counts.sum(1, keepdims=True), 1) * 10_000)


def entries(spark, x):
    rows = [(int(i), f"g{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "cell_id long, gene string, x double").repartition(4)


def test_singular_vectors_are_those_of_the_dense_matrix(spark):
    x = matrix()
    cells = spark.range(len(x)).withColumnRenamed("id", "cell_id")
    scores, loadings, values = latent.singular_vectors(entries(spark, x), 3, cells=cells, tolerance=1e-8)
    centred = x - x.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    assert values == pytest.approx(s[:3], abs=1e-6)
    got = np.array([[r.c1, r.c2, r.c3] for r in sorted(scores.collect(), key=lambda r: r.cell_id)])
    turned = np.array([[r.c1, r.c2, r.c3] for r in sorted(loadings.collect(), key=lambda r: r.gene)])
    for j in range(3):
        sign = np.sign(v[j, np.abs(v[j]).argmax()])
        assert np.abs(turned[:, j] - sign * v[j]).max() < 1e-4 and np.abs(got[:, j] - sign * u[:, j] * s[j]).max() < 1e-3
    assert len(got) == 60 and np.abs(got[7] - (-x.mean(0)) @ turned).max() < 1e-3


def test_a_round_writes_nothing_for_the_cells(spark, monkeypatch):
    """What is written are the cells' rows, once, and the genes' means; sent or joined, the columns are the same."""
    kept = []

    class Counted(latent.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            kept.append(out.count())
            return out

    monkeypatch.setattr(latent, "Scratch", Counted)
    monkeypatch.setattr(latent, "ENTRIES", 32)
    x, cells = matrix(), spark.range(60).withColumnRenamed("id", "cell_id")
    odd = spark.createDataFrame([(3, None, 5.0), (None, "g01", 5.0), (7, "g01", None)], "cell_id long, gene string, x double")
    both = []
    for more in ({}, {"sent": 0}):
        scores, loadings, values = latent.singular_vectors(entries(spark, x).unionByName(odd), 3, cells=cells, most=4, **more)
        both.append((np.array([list(r)[1:] for r in sorted(scores.collect())]), np.array([list(r)[1:] for r in sorted(loadings.collect())]), values))
        if not more:
            assert kept == [60, 25]
    assert len(both[0][0]) == 60 and all(np.abs(np.array(a) - np.array(b)).max() < 1e-8 for a, b in zip(*both, strict=True))


def test_rank_below_the_columns_asked_for_and_empty_tables(spark):
    x = np.outer([0.0, 1.0, 2.0, 3.0], [1.0, 2.0])
    scores, loadings, values = latent.singular_vectors(entries(spark, x), 5, cells=spark.range(4).withColumnRenamed("id", "cell_id"))
    assert values == pytest.approx([5.0]) and scores.columns == ["cell_id", "c1"] and loadings.count() == 2
    scores, _, values = latent.singular_vectors(entries(spark, x).where("x < 0"), 2)
    assert values == [] and scores.count() == 0
