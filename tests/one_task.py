"""Communities found in one task: what the distributed search is held against."""

import numpy as np


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, passes: int = 10) -> np.ndarray:
    """Communities by greedy modularity moves and aggregation (Blondel et al. 2008), in a fixed order; numbered by size."""
    of = np.arange(n)
    node = np.arange(n)
    total = 2 * w.sum()
    for _ in range(passes):
        m = node.max() + 1
        x, y = node[a], node[b]
        loops = np.bincount(x[x == y], w[x == y], m)
        x, y, v = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
        away = x != y
        key, at = np.unique(x[away] * m + y[away], return_inverse=True)
        weight = np.bincount(at, v[away])
        src, dst = key // m, key % m
        first = np.searchsorted(src, np.arange(m + 1))
        degree = np.bincount(src, weight, m) + 2 * loops
        group, held = np.arange(m), degree.copy()
        moved, rounds = True, 0
        while moved and rounds < 20:
            moved, rounds = False, rounds + 1
            for i in range(m):
                near, ws = group[dst[first[i] : first[i + 1]]], weight[first[i] : first[i + 1]]
                if not len(near):
                    continue
                held[group[i]] -= degree[i]
                names, slot = np.unique(np.append(near, group[i]), return_inverse=True)
                gain = np.bincount(slot, np.append(ws, 0.0)) - resolution * degree[i] * held[names] / total
                best = names[gain.argmax()]
                if gain.max() <= gain[np.searchsorted(names, group[i])] + 1e-12:
                    best = group[i]
                held[best] += degree[i]
                moved |= bool(best != group[i])
                group[i] = best
        names, group = np.unique(group, return_inverse=True)
        if len(names) == m:
            break
        node = group[node]
    of = node
    sizes = np.bincount(of)
    place = np.empty(len(sizes), int)
    place[np.lexsort((np.arange(len(sizes)), -sizes))] = np.arange(len(sizes))
    return place[of]
