import numpy as np
import pytest

from lumenframe.operators import dendrogram


def slowly(x):
    """Ward's merges by looking at all pairs each time: the increase of the sum of squares, doubled, is the squared height."""
    groups = {i: [i] for i in range(len(x))}
    out = []
    while len(groups) > 1:
        def height(a, b):
            p, q = x[groups[a]], x[groups[b]]
            return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))

        h, a, b = min((height(a, b), a, b) for a in groups for b in groups if a < b)
        out.append((a, b, h))
        groups[len(x) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return out


@pytest.mark.parametrize("n", [2, 3, 8, 25])
def test_linkage_is_that_of_all_pairs(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    got, want = dendrogram.ward_linkage(x), slowly(x)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert sorted(dendrogram.leaves(got, n)) == list(range(n))


def test_a_tree_by_hand_with_ties():
    """0 and 1, and 10 and 11, are as near; the lower pair first. 30 joins last."""
    x = np.array([[0.0], [10.0], [1.0], [30.0], [11.0]])
    merges = dendrogram.ward_linkage(x)
    assert [m[:2] for m in merges] == [(0, 2), (1, 4), (5, 6), (3, 7)]
    assert [round(m[2], 6) for m in merges] == [1.0, 1.0, round(np.sqrt(2) * 10, 6), round(np.sqrt(2 * 4 / 5) * 24.5, 6)]
    assert dendrogram.leaves(merges, 5) == [3, 0, 2, 1, 4]
    equal = dendrogram.ward_linkage(np.zeros((4, 2)))
    assert sorted(dendrogram.leaves(equal, 4)) == [0, 1, 2, 3] and dendrogram.leaves([], 1) == [0]


def test_orders_of_columns(spark):
    values = {"a": (0.0, 5.0), "b": (9.0, 0.0), "c": (0.0, -6.0), "d": (9.0, 1.0), "e": (-9.0, 0.0)}
    rows = [(s, g, v[k], "abcde".index(g)) for g, v in values.items() for k, s in enumerate(("x", "y")) if v[k]]
    table = spark.createDataFrame(rows, "state string, gene string, value double, at int")
    order = lambda **o: [r.gene for r in sorted(dendrogram.ordered_columns(table, ["x", "y"], **o).collect(), key=lambda r: r.place)]
    assert order(mode="max_state") == ["b", "d", "e", "c", "a"]
    assert order(mode="input", place="at") == list("abcde") == order(mode="clustered", place="at", most=4)
    x = np.array([values[g] for g in "abcde"])
    assert order(place="at") == ["abcde"[i] for i in dendrogram.leaves(slowly(x), 5)]
    assert dendrogram.ordered_columns(table.where("state = 'z'"), ["x"]).collect() == []
    with pytest.raises(ValueError, match="mode"):
        dendrogram.ordered_columns(table, ["x"], mode="other")
