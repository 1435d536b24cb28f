"""Neighbours of whole tables, the weighted graph, communities, spread labels, the map."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import graph, nearest_index, neighbors

from .one_task import louvain


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, z array<double>").repartition(5)


def by_comparison(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(x))}


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, {})[r["rank"]] = r.neighbour
    return {i: [n for _, n in sorted(v.items())] for i, v in out.items()}


@pytest.fixture(scope="module")
def blobs():
    """Six groups of points, some of them equal, some on a grid of many ties."""
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(60, 5)) for c in rng.normal(size=(6, 5)) * 6])
    return x, np.repeat(np.arange(6), 60)


@pytest.fixture(scope="module")
def weighted(spark, blobs):
    near = nearest_index.nearest_of_all(table(spark, blobs[0]), 14).persist()
    return near, graph.fuzzy_graph(near, 15).persist()


def test_exact_neighbours_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 6)), np.repeat(rng.normal(size=(3, 6)), 60, 0), rng.integers(0, 2, (150, 6)).astype(float)])
    ids = 3 * np.arange(len(x))
    odd = spark.createDataFrame([(None, [1.0] * 6), (1, None), (2, [math.nan] * 6), (4, [math.inf] * 6), (5, [])], "id long, z array<double>")
    points = table(spark, x, ids).unionByName(odd)
    want = by_comparison(x, ids, 8)
    assert listed(nearest_index.nearest_of_all(points, 8, probes=3, block=100)) == want
    some = listed(nearest_index.nearest_of_all(points, 8, probes=6, block=100, exact=False))
    assert set(some) <= set(want) and np.mean([len(set(some.get(i, [])) & set(w)) / 8 for i, w in want.items()]) > 0.7


def test_probing_finds_nine_tenths(spark):
    """Vectors in groups, as latent spaces are: the probe list of eight cells of 44."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in rng.normal(size=(20, 16)) * 3])
    points = table(spark, x)
    true = nearest_index.nearest_of_all(points, 10)
    found = nearest_index.nearest_of_all(points, 10, exact=False)
    assert nearest_index.recall(found, true).first()[0] > 0.9 and listed(true) == by_comparison(x, np.arange(len(x)), 10)


def test_what_is_written_does_not_grow_with_the_cells(spark, monkeypatch):
    """Vectors of which the triangle inequality rules out next to none: each is written a fixed number of times, whatever the number of cells."""
    written = []

    class Weighed(nearest_index.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            written.append(out.count() if "vector" in out.columns else 0)
            return out

    monkeypatch.setattr(nearest_index, "Scratch", Weighed)
    x = np.random.default_rng(7).normal(size=(1600, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    assert listed(nearest_index.nearest_of_all(table(spark, x), 10)) == by_comparison(x, np.arange(len(x)), 10)
    assert max(written) == len(x) and sum(written) <= 3 * len(x)


def test_neighbours_of_few_points(spark):
    none = spark.createDataFrame([], "id long, z array<double>")
    assert nearest_index.nearest_of_all(none, 3).collect() == []
    assert nearest_index.nearest_of_all(table(spark, [[1.0]]), 3).collect() == []
    got = nearest_index.nearest_of_all(table(spark, [[1.0], [1.0], [4.0]]), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0.0), (0, 2, 2, 3.0), (1, 0, 1, 0.0), (1, 2, 2, 3.0), (2, 0, 1, 3.0), (2, 1, 2, 3.0)]


def test_strengths_add_up(spark, weighted):
    near, edges = weighted
    sums = [r.s for r in graph.directed_strengths(near, 15).groupBy("id").agg(F.sum("strength").alias("s")).collect()]
    assert len(sums) == 360 and max(abs(s - math.log2(15)) for s in sums) < 1e-5
    one_way = {(r.id, r.neighbour): r.strength for r in graph.directed_strengths(near, 15).collect()}
    for r in edges.collect():
        x, y = one_way.get((r.a, r.b), 0.0), one_way.get((r.b, r.a), 0.0)
        assert r.a < r.b and r.weight == pytest.approx(x + y - x * y)
    equal = nearest_index.nearest_of_all(table(spark, [[0.0]] * 4 + [[1.0]]), 3)
    assert all(0 <= r.strength <= 1 for r in graph.directed_strengths(equal, 4).collect())


def arrays(edges):
    rows = edges.collect()
    return np.array([r.a for r in rows]), np.array([r.b for r in rows]), np.array([r.weight for r in rows])


def value(a, b, w, of, resolution):
    k = np.bincount(a, w, len(of)) + np.bincount(b, w, len(of))
    return w[of[a] == of[b]].sum() / w.sum() - resolution * (np.bincount(of, k) ** 2).sum() / k.sum() ** 2


def is_connected(nodes, a, b):
    nodes, seen, todo = set(nodes), set(), [min(nodes)]
    near = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [m for m in near.get(n, []) if m in nodes]
    return seen == nodes


def test_communities_are_connected_and_as_good_as_in_one_task(spark, blobs, weighted):
    a, b, w = arrays(weighted[1])
    found = graph.communities(weighted[1], [0.5, 4.0]).persist()
    values = {r.resolution: r.modularity for r in graph.modularity(weighted[1], found).collect()}
    for resolution in (0.5, 4.0):
        of = np.zeros(360, int)
        for r in found.where(F.col("resolution") == resolution).collect():
            of[r.node] = int(r.cluster)
        assert values[resolution] == pytest.approx(value(a, b, w, of, resolution))
        assert values[resolution] >= 0.99 * value(a, b, w, louvain(360, a, b, w, resolution), resolution)
        sizes = np.bincount(of)
        assert (np.diff(sizes) <= 0).all() and all(is_connected(np.flatnonzero(of == c).tolist(), a, b) for c in range(len(sizes)))
        if resolution == 0.5:
            assert len(sizes) == 6 and all(len(set(of[blobs[1] == g])) <= 2 for g in range(6))
    assert graph.communities(weighted[1].where("a < 0"), [1.0]).collect() == []


def test_merged_graphs_of_bounded_size_are_searched_by_a_task(spark, weighted, monkeypatch):
    """The rounds of joins end with the first level where what it merges to is small; by joins alone, or in a task from the start, communities are as good."""
    a, b, w = arrays(weighted[1])
    names = []

    class Named(graph.Scratch):
        def keep(self, df, name):
            names.append(name)
            return super().keep(df, name)

    monkeypatch.setattr(graph, "Scratch", Named)
    found = graph.communities(weighted[1], [1.0]).collect()
    assert names.count("belongs") == 1 and names.count("searched") == 1
    of = np.zeros(360, int)
    for r in found:
        of[r.node] = int(r.cluster)
    best = value(a, b, w, louvain(360, a, b, w, 1.0), 1.0)
    assert value(a, b, w, of, 1.0) >= 0.99 * best
    k = np.bincount(a, w, 360) + np.bincount(b, w, 360)
    of = graph.searched(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), k, np.arange(360), 1.0, k.sum())
    assert value(a, b, w, of, 1.0) >= 0.99 * best


def test_labels_spread(spark, blobs, weighted):
    known = {i: f"g{blobs[1][i]}" for i in range(0, 360, 20)}
    labels = spark.createDataFrame([*known.items(), (7, None)], "node long, label string")
    shares = graph.spread_labels(weighted[1], labels).persist()
    told = {r.node: r.pred_label for r in graph.told_labels(shares).collect()}
    assert np.mean([told[i] == f"g{blobs[1][i]}" for i in range(360)]) > 0.97
    # The same by matrices.
    a, b, w = arrays(weighted[1])
    s = np.zeros((360, 360))
    s[a, b] = s[b, a] = w
    d = np.sqrt(s.sum(1))
    s /= d[:, None] * d
    y = np.zeros((360, 6))
    for i, g in known.items():
        y[i, int(g[1])] = 1
    f = y.copy()
    for _ in range(20):
        f = 0.9 * s @ f + 0.1 * y
    f /= f.sum(1, keepdims=True)
    got = np.zeros_like(f)
    for r in shares.collect():
        got[r.node, int(r.label[1])] = r.share
    assert np.abs(got - f).max() < 1e-9


def test_a_nodes_shares_travel_in_a_row(spark, blobs, weighted, monkeypatch):
    """A round has a row for each node, not for each node and label, and the graph is made once; shares do not depend on the labels of a row, nor on how state reaches the steps."""
    kept = {}

    class Counted(graph.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            kept.setdefault(name, []).append(out.count())
            return out

    labels = spark.createDataFrame([(i, f"g{blobs[1][i]}") for i in range(0, 360, 20)], "node long, label string")
    monkeypatch.setattr(graph, "Scratch", Counted)
    found = [{(r.node, r.label): r.share for r in graph.spread_labels(weighted[1], labels, rounds=6, **more).collect()} for more in ({}, {"wide": 4, "sent": 0})]
    assert kept["edges"] == [2 * weighted[1].count()] * 2 and kept["shares"][0] <= 360 and found[0].keys() == found[1].keys()
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-12
    assert graph.spread_labels(weighted[1], labels.where("node < 0")).collect() == []


def test_map_is_made_of_eigenvectors(spark, weighted):
    a, b, w = arrays(weighted[1])
    s = np.zeros((360, 360))
    s[a, b] = s[b, a] = w
    d = np.sqrt(s.sum(1))
    s = (np.eye(360) + s / (d[:, None] * d)) / 2
    x = np.zeros((360, 2))
    for r in graph.spectral_map(weighted[1]).collect():
        x[r.node] = r.x1, r.x2
    top = np.sort(np.linalg.eigvalsh(s))[::-1]
    for j in range(2):
        assert np.linalg.norm(x[:, j]) == pytest.approx(1.0, abs=1e-6) and x[np.abs(x[:, j]).argmax(), j] > 0
        value_ = x[:, j] @ s @ x[:, j]
        assert np.linalg.norm(s @ x[:, j] - value_ * x[:, j]) < 1e-5 and value_ == pytest.approx(top[j + 1], abs=1e-6)


def test_a_step_of_the_map_reads_its_state_once(spark, weighted, monkeypatch):
    """A round of eight steps has eight joins: before, each step had its state twice, and a round some hundreds."""
    plans = []

    class Planned(graph.Scratch):
        def keep(self, df, name):
            if name == "filtered":
                plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
            return super().keep(df, name)

    monkeypatch.setattr(graph, "Scratch", Planned)
    graph.spectral_map(weighted[1], 1, most=1)
    assert plans == [8]


def test_distances_held_by_a_task_are_bounded():
    assert all(neighbors._rows(n) * n <= neighbors.HELD for n in (1, 5_000, 50_000)) and neighbors._rows(0) == neighbors._rows(1) == neighbors.BLOCK


def test_points_are_compared_within_their_group_only(monkeypatch):
    """Neighbours and silhouettes within the values of a column: the distances made are those within, and the results are those of all comparisons."""
    rng = np.random.default_rng(4)
    x, of, batch, ids = rng.normal(size=(90, 3)), np.repeat([0, 1, 2], 30), np.tile([0, 1, 1], 30), 2 * np.arange(90)
    made, work = [], []
    rough = neighbors._squared
    monkeypatch.setattr(neighbors, "_squared", lambda q, *rest: made.append(len(q) * len(rest[0])) or rough(q, *rest))
    shared = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    points = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=shared), schema={"l": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))})
    points.select = lambda *_: SimpleNamespace(mapInArrow=lambda f, _: work.append(f))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist()), pa.array(batch)], names=["id", "z", "l"])
    monkeypatch.setattr(neighbors.F, "col", lambda _: SimpleNamespace(cast=lambda _: None))
    monkeypatch.setattr(neighbors, "_sample", lambda *_: (ids, x, of) if len(_) == 4 else (ids, x, batch, of))
    neighbors.nearest(points, 4, within="of")
    neighbors.silhouettes(points, "l", within="of")
    near, told = ([r for out in f([rows]) for r in out.to_pylist()] for f in work)
    assert sum(made) == 2 * 3 * 30 * 30
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        mates = [j for j in range(90) if of[j] == of[i] and j != i]
        assert [r["neighbour"] for r in near if r["id"] == ids[i]] == [ids[j] for j in sorted(mates, key=lambda j: d[i, j])[:4]]
        a, b = (np.mean([d[i, j] for j in mates if (batch[j] == batch[i]) == same]) for same in (True, False))
        assert next(r["s"] for r in told if r["id"] == ids[i]) == pytest.approx((b - a) / max(a, b))


def test_map_separates_two_groups(spark):
    edges = [(i, j, 1.0) for s in (0, 8) for i in range(s, s + 8) for j in range(i + 1, s + 8)] + [(0, 8, 0.1)]
    got = {r.node: r.x1 for r in graph.spectral_map(spark.createDataFrame(edges, "a long, b long, weight double"), 1).collect()}
    assert len({got[i] > 0 for i in range(8)}) == 1 and (got[0] > 0) != (got[8] > 0)


def test_moves_by_a_sent_state_are_those_of_the_joins(spark, weighted, monkeypatch):
    """With the nodes' state sent, a level's moves and parts are each written once (before, round by round), and what is found is the same."""
    names = []

    class Named(graph.Scratch):
        def keep(self, df, name):
            names.append(name)
            return super().keep(df, name)

    rows = lambda df: sorted(df.collect())
    want = rows(graph.communities(weighted[1], [0.5, 4.0], sent=0))
    monkeypatch.setattr(graph, "Scratch", Named)
    monkeypatch.setattr(graph, "PACKED", 500)  # several blocks
    assert rows(graph.communities(weighted[1], [0.5, 4.0])) == want and len(want) == 720
    assert names.count("moved") == names.count("parts") == names.count("belongs") == 1


def test_nodes_go_where_they_gain_most():
    """Against all gains one by one: links less what is expected, of equal gains to the smallest group, and only where a rule lets them."""
    rng = np.random.default_rng(6)
    x = np.triu(rng.integers(0, 3, (30, 30)) * (rng.random((30, 30)) < 0.3), 1).astype(float)
    x += x.T
    a, b = np.nonzero(x)
    k, of, total = x.sum(1), rng.integers(0, 8, 30), x.sum()
    gives, takes = rng.integers(0, 4, 8), rng.integers(0, 4, 8)
    want = {}
    for i in range(30):
        gain = {g: round(x[i, of == g].sum() - 0.7 * k[i] * (k[of == g].sum() - (g == of[i]) * k[i]) / total, 9) for g in range(8)}
        may = [g for g in range(8) if g != of[i] and x[i, of == g].sum() > 0 and takes[g] > gives[of[i]] and gain[g] > gain[of[i]]]
        if may:
            want[i] = max(may, key=lambda g: (gain[g], -g))
    node, to = graph.goes(a, b, x[a, b], k, of, 0.7, total, gives, takes)
    assert want and dict(zip(node.tolist(), to.tolist(), strict=True)) == want
    none = np.zeros(0, np.int64)
    assert not len(graph.goes(none, none, np.zeros(0), k, of, 0.7, total, gives, takes)[0])


def test_what_falls_apart_is_split():
    a, b = np.array([0, 1, 2, 3, 1, 4]), np.array([1, 0, 3, 2, 4, 1])
    assert graph._split(a, b, np.array([0, 0, 0, 0, 5, 5])).tolist() == [0, 0, 2, 2, 4, 5]


def test_the_first_levels_edges_are_written_once_for_all_resolutions(spark, weighted, monkeypatch):
    """Before, they were written, read and merged for each resolution; merging by blocks is that of the joins."""
    kept = {}

    class Counted(graph.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            kept.setdefault(name, []).append(out)
            return out

    monkeypatch.setattr(graph, "Scratch", Counted)
    monkeypatch.setattr(graph, "PACKED", 500)  # several blocks
    graph.communities(weighted[1], [0.2, 0.5, 4.0])
    both = 2 * weighted[1].count()
    assert kept["edges"][0].count() == both and sum(len(r.weight) // 8 for r in kept["blocks"][0].collect()) == both
    rows = lambda df: {(r.r, r.a, r.b): r.weight for r in df.collect()}
    levels = F.explode(F.lit([0.2, 0.5, 4.0])).alias("r")
    level = graph._Level(kept["edges"][0].select(levels, "a", "b", "weight"), 1.0, graph.Scratch(spark, "test"))
    want = rows(level.merged(kept["parts"][0]))
    got = rows(kept["edges"][1])
    assert want and got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)


def test_the_state_of_a_table_six_times_as_large_is_sent():
    """Before, 300,000 nodes of all resolutions together were: 102,564 vectors at three already moved by joins, a shuffle of all edges for each round and resolution."""
    assert graph.communities.__kwdefaults__["sent"] >= 3 * 615_384


def test_hashes_made_on_the_driver_are_sparks(spark):
    values = [0, 1, -1, 7, 615_384, 10_000_000_000, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").select("i", *[F.xxhash64("v", F.lit(j)).alias(f"h{j}") for j in range(30)]).orderBy("i").collect()
    for j in range(30):
        assert graph.hashed(np.array(values), j).tolist() == [r[f"h{j}"] for r in rows]
