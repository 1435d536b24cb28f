"""The weighted neighbour graph, and what is worked out on it: communities, spread labels, a map.

Edges are rows of written tables, and every step is a join and a group by; no graph is ever in one task, but for what communities have been merged to, once that has a bounded number of
edges.  Loops keep their state in written tables, round by round, so a lost executor costs no finished round; a bounded state of moves is kept where it is sent from.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Halvings of the bandwidth's bracket, and the least bandwidth as a share of the mean distance.
HALVINGS, LEAST_BANDWIDTH = 64, 1e-3
#: Rounds of moves of a level, levels, and the gain of modularity that is worth another round.
ROUNDS, LEVELS, WORTH = 30, 12, 1e-6
#: Edges of a merged graph, both directions counted, that a task may search; larger ones are searched by joins. The graph itself always is.
MERGED = 400_000
#: Nodes whose state is sent to every task at a step of a map, and at a round of moves (all resolutions together, some eight bytes each); beyond, it is joined.
SENT, MOVED = 300_000, 4_000_000
#: Edges of a block that is compared with a state that was sent, about.
PACKED = 1 << 17
#: Labels whose shares are in a row, and numbers of a state of shares that are sent to every task at a round; beyond, it is joined.
WIDE, SENT_NUMBERS = 32, 8_000_000


def bandwidths(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest distance above 0, bandwidth) of rows of distances, padded by infinity: with d the distances above the nearest, exp(-d / bandwidth) adds up to log2(k)."""
    finite = np.isfinite(distances)
    nearest = np.where((distances > 0) & finite, distances, np.inf).min(1, initial=np.inf)
    nearest = np.where(np.isfinite(nearest), nearest, 0.0)
    above = np.where(finite, np.maximum(distances - nearest[:, None], 0.0), np.inf)
    low, high, middle = np.zeros(len(above)), np.full(len(above), np.inf), np.ones(len(above))
    for _ in range(HALVINGS):
        total = np.exp(-above / middle[:, None]).sum(1)
        over = total > math.log2(k)
        high, low = np.where(over, middle, high), np.where(over, low, middle)
        middle = np.where(np.isinf(high), 2 * middle, (low + high) / 2)
    mean = np.where(finite, distances, 0.0).sum(1) / np.maximum(finite.sum(1), 1)
    return nearest, np.maximum(middle, LEAST_BANDWIDTH * mean)


def directed_strengths(near: DataFrame, k: int, *, key: str = "id") -> DataFrame:
    """(key, neighbour, strength) of neighbours (key, neighbour, distance): how surely each is one, from 1 at the nearest, log2(k) in all (k counts the point itself, so there are k - 1 others)."""
    lists = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))  # k - 1 each

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            d, sizes = lists.flatten().field("distance").to_numpy(), lists.value_lengths().to_numpy()
            inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
            table = np.full(inside.shape, np.inf)
            table[inside] = d
            nearest, width = bandwidths(table, k)
            strength = np.exp(-np.maximum(table - nearest[:, None], 0.0) / np.where(width > 0, width, 1.0)[:, None])[inside]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), lists.flatten().field("neighbour"), pa.array(strength)], names=[key, "neighbour", "strength"])

    return lists.mapInArrow(work, f"{key} long, neighbour long, strength double")


def fuzzy_graph(near: DataFrame, k: int, *, key: str = "id") -> DataFrame:
    """(a, b, weight), a < b: the union of both directions' strengths, x + y - x y."""
    strengths = directed_strengths(near, k, key=key).where(F.col(key) != F.col("neighbour"))
    ends = [F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")]
    both = strengths.groupBy(*ends).agg(F.sum("strength").alias("sum"), F.product("strength").alias("product"), F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("n") > 1, F.col("sum") - F.col("product")).otherwise(F.col("sum"))
    return both.select("a", "b", weight.alias("weight")).where("weight > 0")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Edges (a, b, weight) in both directions; of repeated ones the largest weight, none from a node to itself or of weight 0 and below."""
    one = edges.where("a <> b AND weight > 0").groupBy(*more, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").cast("double").alias("weight"))
    return one.select(*more, "a", "b", "weight").unionByName(one.select(*more, F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float | Column = 1.0) -> DataFrame:
    """(resolution, modularity) of clusters (resolution, node, cluster) on edges (a, b, weight)."""
    both = both_ways(edges)
    named = lambda end: clusters.select(F.col("resolution").alias(f"r_{end}"), F.col("node").alias(end), F.col("cluster").alias(f"c_{end}"))
    placed = both.join(named("a"), "a").join(named("b"), "b").where("r_a = r_b").withColumnRenamed("r_a", "resolution")
    inside = placed.groupBy("resolution").agg(F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    held = placed.groupBy("resolution", "c_a").agg(F.sum("weight").alias("held")).groupBy("resolution").agg(F.sum(F.col("held") ** 2).alias("squares"))
    return inside.join(held, "resolution").select("resolution", (F.col("inside") / F.col("total") - F.col("resolution") * F.col("squares") / F.col("total") ** 2).alias("modularity"))


class _Level:
    """One level of the search, of all resolutions at once: edges (r, a, b, weight) in both directions, nodes (r, node, k, c)."""

    def __init__(self, edges: DataFrame, total: float, scratch: Scratch) -> None:
        self.edges, self.total, self.scratch = edges, total, scratch

    def values(self, nodes: DataFrame) -> dict[float, float]:
        """Each resolution's modularity, but for what lies within the nodes, which no move changes."""
        c = lambda end: nodes.select("r", F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        inside = self.edges.join(c("a"), ["r", "a"]).join(c("b"), ["r", "b"]).where("c_a = c_b").select("r", (F.col("weight") / F.lit(self.total)).alias("part"))
        held = nodes.groupBy("r", "c").agg(F.sum("k").alias("held")).select("r", (-F.col("r") * (F.col("held") / F.lit(self.total)) ** 2).alias("part"))
        return dict(inside.unionByName(held).groupBy("r").agg(F.sum("part")).collect())

    def _gains(self, nodes: DataFrame, group: str, edges: DataFrame, allowed: Column) -> DataFrame:
        """(r, node, from, to, links, gain): what nodes gain in neighbouring groups that they are allowed to go to, and in their own without themselves."""
        of_b = nodes.select("r", F.col("node").alias("b"), F.col(group).alias("to"))
        links = edges.join(of_b, ["r", "b"]).select("r", F.col("a").alias("node"), "to", "weight")
        own = nodes.select("r", "node", F.col(group).alias("to"), F.lit(0.0).alias("weight"))
        links = links.unionByName(own).groupBy("r", "node", "to").agg(F.sum("weight").alias("links"))
        held = nodes.groupBy("r", F.col(group).alias("to")).agg(F.sum("k").alias("held"))
        rows = links.join(nodes.select("r", "node", "k", F.col(group).alias("from")), ["r", "node"])
        rows = rows.where((F.col("to") == F.col("from")) | allowed).join(held, ["r", "to"])
        others = F.col("held") - F.when(F.col("to") == F.col("from"), F.col("k")).otherwise(0.0)
        return rows.withColumn("gain", F.round(F.col("links") - F.col("r") * F.col("k") * others / F.lit(self.total), 9))

    def moved(self, nodes: DataFrame) -> DataFrame:
        """nodes after rounds in which they move to the neighbouring community of the largest gain, while modularity rises.

        In even rounds they go up in the order of a hash of the communities, in odd ones down, so no two communities swap nodes.
        """
        values, idle = self.values(nodes), 0
        for round_ in range(ROUNDS):
            place = lambda g: F.struct(F.xxhash64(g, F.lit(round_ // 2)), F.col(g))  # noqa: B023, E731
            up = place("to") > place("from")
            gains = self._gains(nodes, "c", self.edges, up if round_ % 2 == 0 else ~up)
            best = F.max_by("to", F.struct("gain", F.col("to") == F.col("from"), -F.col("to")))  # every node has a row, of its own community
            now = self.scratch.keep(gains.groupBy("r", "node").agg(F.max("k").alias("k"), best.alias("c")), "moved")
            risen = self.values(now)
            better = [r for r, v in risen.items() if v > values[r]]
            idle = 0 if any(risen[r] > values[r] + WORTH for r in better) else idle + 1
            if better:
                taken = F.col("r").isin(better)
                nodes = now if len(better) == len(values) else now.where(taken).unionByName(nodes.where(~taken))
                values |= {r: risen[r] for r in better}
            if idle == 2:
                break
        return nodes

    def refined(self, nodes: DataFrame) -> DataFrame:
        """nodes with part: nodes that are alone join a neighbouring part of their community, and never leave it again, so every part is connected.

        A coin for each part and round says whether it gives or takes: no node goes where another is leaving.
        """
        c = lambda end: nodes.select("r", F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        inside = self.edges.join(c("a"), ["r", "a"]).join(c("b"), ["r", "b"]).where("c_a = c_b").select("r", "a", "b", "weight")
        inside = self.scratch.keep(inside, "inside")
        parts, idle = nodes.withColumn("part", F.col("node")), 0
        for round_ in range(ROUNDS):
            takes = lambda g: F.pmod(F.xxhash64(g, F.lit(round_)), F.lit(2)) == 1  # noqa: B023, E731
            gains = self._gains(parts, "part", inside, takes("to") & ~takes("from")).where("to <> from AND gain > 0 AND links > 0")
            alone = parts.groupBy("r", F.col("part").alias("from")).agg(F.count(F.lit(1)).alias("mates")).where("mates = 1").select("r", "from")
            best = gains.join(alone, ["r", "from"], "left_semi").groupBy("r", "node").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("best"))
            parts = self.scratch.keep(parts.join(best, ["r", "node"], "left").select("r", "node", "k", "c", F.coalesce("best", "part").alias("part"), F.col("best").isNotNull().alias("joined")), "parts")
            idle = idle + 1 if parts.where("joined").isEmpty() else 0
            parts = parts.drop("joined")
            if idle == 2:
                break
        return parts

    def merged(self, parts: DataFrame) -> DataFrame:
        """Edges between parts; what lies between two of them is one edge."""
        part = lambda end: parts.select("r", F.col("node").alias(end), F.col("part").alias(f"p_{end}"))
        placed = self.edges.join(part("a"), ["r", "a"]).join(part("b"), ["r", "b"]).where("p_a <> p_b")
        return self.scratch.keep(placed.groupBy("r", F.col("p_a").alias("a"), F.col("p_b").alias("b")).agg(F.sum("weight").alias("weight")), "edges")


def hashed(values: np.ndarray, j: int) -> np.ndarray:
    """Spark's xxhash64(values, lit(j)) of whole numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    first = (np.uint64(42 + 8) + p5) ^ (turned(np.asarray(values, np.int64).view(np.uint64) * p2, 31) * p1)
    first = mixed(turned(first, 27) * p1 + p4)
    return mixed(turned((first + (p5 + np.uint64(4))) ^ np.multiply(np.uint64(j), p1, dtype=np.uint64), 23) * p2 + p3).view(np.int64)


def goes(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, of: np.ndarray, r: float, total: float, gives: np.ndarray, takes: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, group) of the nodes that gain most in another group, all its edges being among (a, b, w): they may go where takes of the group is above gives of their own; of equal gains to the smallest.

    held is the sum of k of each group, if it is known."""
    held, to, own = np.bincount(of, k) if held is None else held, of[b], of[a]
    # Nodes that may go nowhere are left out before the sort.
    able = np.zeros(len(k), bool)
    able[a[(takes[to] > gives[own]) & (to != own)]] = True
    some = able[a]
    a, to, w = a[some], to[some], w[some]
    if not len(a):
        return a, to
    pairs = a.astype(np.int64) * len(takes) + to
    order = np.argsort(pairs)
    first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
    links = np.add.reduceat(w[order], first)
    node, to = a[order[first]], to[order[first]]
    own = to == of[node]
    gain = np.round(links - r * k[node] * (held[to] - own * k[node]) / total, 9)
    new = np.diff(node, prepend=-1) != 0
    who, at = node[new], np.cumsum(new) - 1
    stays = np.round(-r * k[who] * (held[of[who]] - k[who]) / total, 9)
    stays[at[own]] = gain[own]
    may = ~own & (takes[to] > gives[of[node]])
    node, to, gain, at = node[may], to[may], gain[may], at[may]
    most = np.full(len(who), -np.inf)
    np.maximum.at(most, at, gain)
    best = np.flatnonzero((gain == most[at]) & (gain > stays[at]))
    best = best[np.diff(node[best], prepend=-1) != 0]
    return node[best], to[best]


class _Sent(_Level):
    """A level of so few nodes that their state is sent to every task: a round is one stage over blocks of edges, and the nodes that move come back. The moves are those of the joins.

    Edges without r are those of every resolution: they are written and read once for all. A block has the places of nodes among all, so a round looks up no names.
    """

    def __init__(self, edges: DataFrame, total: float, scratch: Scratch, nodes: DataFrame) -> None:
        super().__init__(edges, total, scratch)
        self.context = edges.sparkSession.sparkContext
        by = [c for c in edges.columns if c == "r"]
        table = nodes.select("r", "node", "k", "c").toArrow()
        columns = [table[c].to_numpy() for c in ("r", "node", "k", "c")]
        self.nodes, self.of, self.names, same = {}, {}, {}, None
        for r in np.unique(columns[0]).tolist():
            ids, k, c = (x[columns[0] == r] for x in columns[1:])
            order = np.argsort(ids)
            names, of = np.unique(c[order], return_inverse=True)
            same = (ids[order], k[order]) if by or same is None else same
            self.nodes[r], self.names[r], self.of[r] = same, names, of.astype(np.int32)
        self.fixed = fixed = self.context.broadcast(self.nodes)

        def pack(rows: pa.Table) -> pa.Table:
            ids = fixed.value[rows["r"][0].as_py()][0] if by else next(iter(fixed.value.values()))[0]
            a, b, w = np.searchsorted(ids, rows["a"].to_numpy()), np.searchsorted(ids, rows["b"].to_numpy()), rows["weight"].to_numpy()
            order = np.lexsort((b, a))
            told = {"a": a[order].astype(np.int32), "b": b[order].astype(np.int32), "weight": w[order]}
            return pa.table({"r": rows["r"][:1] if by else pa.array([None], pa.float64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in told.items()}})

        count = max(self.context.defaultParallelism, -(-edges.count() // PACKED))
        blocks = edges.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(count))).groupBy(*by, "block").applyInArrow(pack, "r double, a binary, b binary, weight binary")
        self.blocks = scratch.keep(blocks.repartition(count), "blocks")

    def _told(self, tell, schema: str, state: dict[float, tuple], within=None) -> DataFrame:
        """What each block tells of the state of its resolutions: tell(r, ids, k, a, b, weight, *state) gives columns after r; with within, of edges within those groups only."""
        fixed, names = self.fixed, [c.split()[0] for c in schema.split(", ")]
        self.shared = shared = self.context.broadcast(state)

        def work(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b, w = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype) for c, dtype in ((1, np.int32), (2, np.int32), (3, np.float64)))
                    known = batch.column(0)[i].as_py()
                    for r in shared.value if known is None else [x for x in (known,) if x in shared.value]:
                        inside = slice(None) if within is None else within.value[r][a] == within.value[r][b]
                        told = tell(r, *fixed.value[r], a[inside], b[inside], w[inside], *shared.value[r])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(told[0]), r)), *map(pa.array, told)], names=names)

        return self.blocks.mapInArrow(work, schema)

    def _values(self, of: dict[float, np.ndarray]) -> dict[float, float]:
        total = self.total
        told = self._told(lambda r, ids, k, a, b, w, of: [np.array([w[of[a] == of[b]].sum() / total])], "r double, part double", {r: (x,) for r, x in of.items()}).toArrow()
        self.shared.destroy()
        rs, parts = told["r"].to_numpy(), told["part"].to_numpy()
        return {r: math.fsum(parts[rs == r]) - r * float(((np.bincount(x, self.nodes[r][1]) / self.total) ** 2).sum()) for r, x in of.items()}

    def _gone(self, of: dict[float, np.ndarray], rules: dict[float, tuple], within=None) -> dict[float, np.ndarray]:
        total = self.total
        held = {r: np.bincount(x, self.nodes[r][1]) for r, x in of.items()}

        def tell(r, ids, k, a, b, w, of, held, gives, takes):
            return [x.astype(np.int32) for x in goes(a, b, w, k, of, r, total, gives, takes, held)]

        told = self._told(tell, "r double, node int, to int", {r: (of[r], held[r], *rules[r]) for r in of}, within).toArrow()
        self.shared.destroy()
        rs, out = told["r"].to_numpy(), {r: x.copy() for r, x in of.items()}
        for r, x in out.items():
            x[told["node"].to_numpy()[rs == r]] = told["to"].to_numpy()[rs == r]
        return out

    def _table(self, name: str, **columns: dict[float, np.ndarray]) -> DataFrame:
        rows = {"r": np.concatenate([np.full(len(ids), r) for r, (ids, _) in self.nodes.items()])}
        rows |= {c: np.concatenate([self.nodes[r][j] for r in self.nodes]) for j, c in enumerate(("node", "k"))}
        rows |= {c: np.concatenate([x[r] for r in self.nodes]) for c, x in columns.items()}
        return self.scratch.keep(self.edges.sparkSession.createDataFrame(pa.table(rows)), name)

    def moved(self, nodes: DataFrame) -> DataFrame:
        of, values, idle = self.of, self._values(self.of), 0
        for round_ in range(ROUNDS):
            if round_ % 2 == 0:
                places = {r: np.empty(len(names), np.int32) for r, names in self.names.items()}
                for r, names in self.names.items():
                    places[r][np.argsort(hashed(names, round_ // 2), kind="stable")] = np.arange(len(names), dtype=np.int32)
            else:
                places = {r: -x for r, x in places.items()}
            now = self._gone(of, {r: (x, x) for r, x in places.items()})
            risen = self._values(now)
            better = [r for r, v in risen.items() if v > values[r]]
            idle = 0 if any(risen[r] > values[r] + WORTH for r in better) else idle + 1
            of = of | {r: now[r] for r in better}
            values |= {r: risen[r] for r in better}
            if idle == 2:
                break
        self.of = of
        return self._table("moved", c={r: self.names[r][x] for r, x in of.items()})

    def refined(self, nodes: DataFrame) -> DataFrame:
        of, idle = {r: np.arange(len(ids), dtype=np.int32) for r, (ids, _) in self.nodes.items()}, 0
        within = self.context.broadcast(self.of)
        for round_ in range(ROUNDS):
            rules = {}
            for r, x in of.items():
                takes = (hashed(self.nodes[r][0], round_) & 1).astype(np.int8)
                rules[r] = np.where((takes == 0) & (np.bincount(x, minlength=len(x)) == 1), 0, 1).astype(np.int8), takes
            now = self._gone(of, rules, within)
            idle = idle + 1 if all((now[r] == x).all() for r, x in of.items()) else 0
            of = now
            if idle == 2:
                break
        within.destroy()
        self.parts = of
        return self._table("parts", c={r: self.names[r][x] for r, x in self.of.items()}, part={r: self.nodes[r][0][x] for r, x in of.items()})

    def merged(self, parts: DataFrame) -> DataFrame:
        def tell(r, ids, k, a, b, w, part):
            away = part[a] != part[b]
            pairs, at = np.unique(part[a[away]].astype(np.int64) * len(ids) + part[b[away]], return_inverse=True)
            return ids[pairs // len(ids)], ids[pairs % len(ids)], np.bincount(at, w[away], len(pairs))

        told = self._told(tell, "r double, a long, b long, weight double", {r: (x,) for r, x in self.parts.items()})
        out = self.scratch.keep(told.groupBy("r", "a", "b").agg(F.sum("weight").alias("weight")), "edges")
        for sent in (self.shared, self.fixed):
            sent.destroy()
        return out


def _swept(edges: tuple[np.ndarray, ...], k: np.ndarray, c: np.ndarray, r: float, total: float, within: np.ndarray | None = None) -> np.ndarray:
    """c after nodes have moved one by one to the group where modularity gains most; with within, only nodes that are alone move, once, and only within their group of that."""
    ends, to, weights, degree, group = (x.tolist() for x in (*edges, k, c))
    held, mates = np.bincount(c, k, len(k)).tolist(), np.bincount(c, minlength=len(k)).tolist()
    inside = None if within is None else within.tolist()
    todo, waits = deque(range(len(degree))), [True] * len(degree)
    while todo:
        i = todo.popleft()
        waits[i], own = False, group[i]
        if inside and mates[own] > 1:
            continue
        near = range(ends[i], ends[i + 1])
        links = {own: 0.0}
        for e in near:
            j = to[e]
            if inside is None or inside[j] == inside[i]:
                links[group[j]] = links.get(group[j], 0.0) + weights[e]
        share = r * degree[i] / total
        best, most = own, links[own] - share * (held[own] - degree[i])
        for g, x in links.items():
            if g != own and x - share * held[g] > most + 1e-9:
                best, most = g, x - share * held[g]
        if best != own:
            for g, sign in ((own, -1), (best, 1)):
                held[g] += sign * degree[i]
                mates[g] += sign
            group[i] = best
            if inside is None:
                for e in near:
                    j = to[e]
                    if not waits[j] and group[j] != best:
                        waits[j] = True
                        todo.append(j)
    return np.array(group, np.int64)


def searched(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, r: float, total: float) -> np.ndarray:
    """The community of each node 0 .. n - 1, by moves, refinement and aggregation in one task; edges are given in both directions, c is where nodes start."""
    at = np.arange(len(k))
    while True:
        n = len(k)
        order = np.lexsort((b, a))
        edges = np.searchsorted(a[order], np.arange(n + 1)), b[order], w[order]
        c = _swept(edges, k, np.unique(c, return_inverse=True)[1], r, total)
        names, part = np.unique(_swept(edges, k, np.arange(n), r, total, c), return_inverse=True)
        at = part[at]
        merged = np.zeros(len(names), np.int64)
        merged[part] = c
        if len(names) == n:
            return merged[at]
        pairs, of = np.unique((part[a] * len(names) + part[b])[part[a] != part[b]], return_inverse=True)
        w = np.bincount(of, w[part[a] != part[b]], len(pairs))
        a, b, k, c = pairs // len(names), pairs % len(names), np.bincount(part, k, len(names)), merged


def _split(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches within its community."""
    inside, label = c[a] == c[b], np.arange(len(c))
    while True:
        least = label.copy()
        np.minimum.at(least, a[inside], label[b[inside]])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _searched(graph: DataFrame, nodes: DataFrame, total: float) -> DataFrame:
    """nodes (r, node, c) after a search of the merged graph of each resolution; communities that fall apart are split."""

    def work(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        ids = nodes["node"].to_numpy()
        a, b = (np.searchsorted(ids, edges[end].to_numpy()) for end in ("a", "b"))
        r = nodes["r"].to_numpy() if len(ids) else np.zeros(0)
        if not len(ids):
            return pa.table({"r": pa.array([], pa.float64()), "node": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        found = searched(a, b, edges["weight"].to_numpy(), nodes["k"].to_numpy(), nodes["c"].to_numpy(), float(r[0]), total)
        return pa.table({"r": r, "node": ids, "c": ids[_split(a, b, found)]})

    return graph.groupBy("r").cogroup(nodes.select("r", "node", "k", "c").groupBy("r")).applyInArrow(work, "r double, node long, c long")


def communities(edges: DataFrame, resolutions: Sequence[float], *, merged: int = MERGED, sent: int = MOVED) -> DataFrame:
    """(node, resolution, cluster) of a graph (a, b, weight), by moves, refinement and aggregation (Traag, Waltman and van Eck 2019).

    Nodes move to the neighbouring community where modularity gains most; no two communities swap nodes in a round, and a round that does not pay is given up. Each community is then built anew
    from its single nodes, so that its parts are connected; the parts are the nodes of the next level, and start in their community. At the end a community that
    falls apart is split: as parts are connected, the last merged graph tells. The state of so many nodes goes to every task at a round; of more, it is joined, with the same moves. A merged graph of no more than so many edges is searched on by a task for each resolution, a larger one by joins as the first is. Clusters are numbered by size, of equals by their smallest node; repeated edges count once, by the largest weight; nodes without an edge are not told. All
    resolutions are searched at once. An empty table gives none.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    levels = F.explode(F.lit([float(r) for r in sorted(set(resolutions))])).alias("r")
    # The first level's edges are the same at every resolution.
    first = scratch.keep(both_ways(edges), "edges")
    graph = first.select(levels, "a", "b", "weight")
    total = first.agg(F.sum("weight")).first()[0] or 0.0
    out = edges.sparkSession.createDataFrame([], "node long, resolution double, cluster string")
    if not total:
        return out
    nodes = scratch.keep(first.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")), "nodes").select(levels, "node", "k", F.col("node").alias("c"))
    belongs = nodes.select("r", "node", F.col("node").alias("at"))
    whole, count = None, nodes.count()
    for depth in range(LEVELS):
        level = _Sent(graph if depth else first, total, scratch, nodes) if count <= sent else _Level(graph, total, scratch)
        nodes = level.moved(nodes)
        parts = level.refined(nodes)
        at = parts.select("r", F.col("node").alias("at"), F.col("part"))
        belongs = scratch.keep(belongs.join(at, ["r", "at"]).select("r", "node", F.col("part").alias("at")), "belongs")
        # Parts are the next nodes.
        graph = level.merged(parts)
        nodes = scratch.keep(parts.groupBy("r", F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.min("c").alias("c")), "nodes")
        now = nodes.count()
        if now == count:
            break
        count = now
        if graph.groupBy("r").count().where(F.col("count") > merged).isEmpty():
            whole = scratch.keep(_searched(graph, nodes, total), "searched")
            break
    if whole is None:
        whole = _connected(graph, nodes.select("r", "node", "c"), scratch)
    found = scratch.keep(belongs.join(whole.withColumnRenamed("node", "at"), ["r", "at"]).select("r", "node", "c"), "found")
    sizes = found.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    number = (F.row_number().over(Window.partitionBy("r").orderBy(F.desc("n"), "least")) - 1).cast("string")  # a row for each community
    return found.join(sizes.select("r", "c", number.alias("cluster")), ["r", "c"]).select("node", F.col("r").alias("resolution"), "cluster")


def _connected(edges: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """found (r, node, c) with communities that are not connected split into what is; c is the smallest node then."""
    c = lambda end: found.select("r", F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
    inside = edges.join(c("a"), ["r", "a"]).join(c("b"), ["r", "b"]).where("c_a = c_b").select("r", "a", "b")
    inside = scratch.keep(inside, "inside")
    labels = scratch.keep(found.select("r", "node", F.col("node").alias("c")), "labels")
    while True:
        near = inside.join(labels.withColumnRenamed("node", "b"), ["r", "b"]).groupBy("r", F.col("a").alias("node")).agg(F.min("c").alias("near"))
        least = labels.join(near, ["r", "node"], "left").select("r", "node", F.least("c", F.coalesce("near", "c")).alias("least"), "c")
        up = least.select("r", F.col("node").alias("least"), F.col("least").alias("far"))
        now = scratch.keep(least.join(up, ["r", "least"], "left").select("r", "node", F.least("least", F.coalesce("far", "least")).alias("now"), "c"), "labels")
        labels = now.select("r", "node", F.col("now").alias("c"))
        if now.where("now <> c").isEmpty():
            return labels


def spread_labels(edges: DataFrame, labels: DataFrame, *, weights: DataFrame | None = None, alpha: float = 0.9, rounds: int = 20, every: int = 5, node: str = "node", label: str = "label", wide: int = WIDE, sent: int = SENT_NUMBERS) -> DataFrame:
    """(node, label, share) of every node of a graph (a, b, weight) that a label reaches: labels spread along edges (Zhou et al. 2004).

    labels (node, label) are those known, null ones and nodes without a row are not; weights (label, weight) makes the labels of some classes count more. Each round, a node's share of a
    label becomes alpha times what its neighbours have, by weight over the root of both ends' degrees, and 1 - alpha times what it is known to have; unlabelled nodes take part and
    pass labels on. Shares add up to 1 at the end. Nodes without an edge keep what they are known to have. A node's shares of so many labels are the columns of a row, null where a label has
    not come; state goes to every task up to so many numbers, and is joined beyond. It is written every so many rounds.
    """
    scratch = Scratch(edges.sparkSession, "spreading")
    both = scratch.keep(both_ways(edges), "edges")
    degrees = scratch.keep(both.groupBy("a").agg(F.sum("weight").alias("d")), "degrees")
    degree = lambda end: degrees.select(F.col("a").alias(end), F.col("d").alias(f"d_{end}"))
    steps = both.join(degree("a"), "a").join(degree("b"), "b").select("a", "b", (F.col("weight") / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("step"))
    # A node's steps lie together, so its sums are made where they are read.
    steps = scratch.keep(steps.repartition("a"), "steps")
    known = labels.where(F.col(label).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(label).alias("label")).distinct()
    if weights is None:
        known = known.withColumn("known", F.lit(1.0))
    else:
        known = known.join(weights.select(F.col(label).alias("label"), F.col("weight").cast("double").alias("known")), "label")
    known = scratch.keep(known.select("node", "label", "known"), "known")
    numbered = (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label")) - 1).alias("number")  # a row for each label
    names = scratch.keep(known.select("label").distinct().select("label", numbered), "names")
    count = names.count()
    wide = max(1, min(wide, count))
    columns = [f"s{j}" for j in range(wide)]
    place = known.join(names, "label").select("node", F.expr(f"number div {wide}").alias("part"), F.expr(f"number % {wide}").alias("at"), "known")
    start = scratch.keep(place.groupBy("node", "part").agg(*[F.sum(F.when(F.col("at") == j, F.col("known"))).alias(c) for j, c in enumerate(columns)]), "start")
    most = (degrees.count() + start.count()) * -(-count // wide) * wide
    shares, written = start, None
    for k in range(rounds):
        state = shares.withColumnRenamed("node", "b")
        come = steps.join(F.broadcast(state) if most <= sent else state, "b").select(F.col("a").alias("node"), "part", *[(alpha * F.col("step") * F.col(c)).alias(c) for c in columns])
        come = come.unionByName(start.select("node", "part", *[((1 - alpha) * F.col(c)).alias(c) for c in columns]))
        shares = come.groupBy("node", "part").agg(*[F.sum(c).alias(c) for c in columns])
        if k % every == every - 1:
            shares = scratch.keep(shares, "shares")
            if written is not None:
                scratch.drop(written)
            written = shares
    whole = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    if count > wide:
        whole = F.sum(whole).over(Window.partitionBy("node"))
    each = shares.withColumn("whole", whole).select("node", "part", "whole", F.posexplode(F.array(*columns)).alias("at", "share")).where("share IS NOT NULL")
    each = each.select("node", F.expr(f"part * {wide} + at").alias("number"), (F.col("share") / F.col("whole")).alias("share"))
    return each.join(names, "number").select(F.col("node").alias(node), F.col("label").alias(label), "share")


def told_labels(shares: DataFrame, *, node: str = "node", label: str = "label") -> DataFrame:
    """(node, pred_label, confidence): the largest share, of equals the smallest label."""
    best = F.row_number().over(Window.partitionBy(node).orderBy(F.desc(F.round("share", 12)), label))
    return shares.withColumn("r_", best).where("r_ = 1").select(node, F.col(label).alias("pred_label"), F.col("share").alias("confidence"))


def spectral_map(edges: DataFrame, k: int = 2, *, most: int = 60, every: int = 8, spare: int = 6, tolerance: float = 1e-6) -> DataFrame:
    """(node, x1 ... xk): each node's place by the eigenvectors of the normalised graph after the first, by filtered orthogonal iteration.

    The iterated matrix is (1 + D^-1/2 W D^-1/2) / 2, whose eigenvalues are 0 to 1; each step is a join and a group by, and a round is so many steps. Orthonormal columns and
    the small problem within their space (some spare columns quicken it) come from Gram matrices of their number on the driver. It ends when the residuals of the map's columns are below
    tolerance, after most rounds at last. Of each column, the entry of the largest size (of equals that of the smallest node) is above 0. Nodes without an edge have no place; an empty
    table gives none.
    """
    scratch = Scratch(edges.sparkSession, "map")
    both = scratch.keep(both_ways(edges), "edges")
    degrees = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d")), "degrees")
    size = degrees.count()
    if size < k + 1:
        return degrees.select("node", *[F.lit(0.0).alias(f"x{j}") for j in range(1, k + 1)])
    end = lambda e: degrees.select(F.col("node").alias(e), F.col("d").alias(f"d_{e}"))
    steps = both.join(end("a"), "a").join(end("b"), "b").select("a", "b", (F.col("weight") / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("step"), F.lit(0.0).alias("own"))
    own = degrees.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("step"), F.lit(1.0).alias("own"))
    # A node's steps lie together, its own entry among them, so its sums are made where they are read.
    steps = scratch.keep(steps.unionByName(own).repartition("a"), "steps")
    names = [f"x{j}" for j in range(min(size, k + 1 + spare))]

    def applied(state: DataFrame, sums: dict[str, str]) -> DataFrame:
        """(node, sums over the steps to nodes of state): each step reads state once, so a chain of steps is a chain of jobs."""
        sent = F.broadcast(state) if size <= SENT else state
        rows = steps.join(sent.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        return rows.agg(*[F.expr(f"sum({x}) AS {name}") for name, x in sums.items()])

    def filtered(state: DataFrame, upto: float) -> DataFrame:
        """A Chebyshev polynomial of the matrix, small on eigenvalues from 0 to upto and large above, times the columns."""
        half = upto / 2
        moved = f"((step + own) / 2 - {half!r}D * own) / {half!r}D"
        before = {f"p{x}": f"own * {x}" for x in names}
        state = applied(state, before | {x: f"{moved} * {x}" for x in names})
        for _ in range(every - 1):
            state = applied(state, before | {x: f"2 * {moved} * {x} - own * p{x}" for x in names})
        return state.select("node", *names)

    noise = lambda j: F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0
    state = degrees.select("node", F.sqrt("d").alias("x0"), *[noise(j).alias(x) for j, x in enumerate(names[1:], 1)])
    upto = 0.9
    for _ in range(most):
        state = scratch.keep(filtered(state, upto), "filtered")
        both_ = scratch.keep(applied(state, {x: f"own * {x}" for x in names} | {f"n{x}": f"(step + own) / 2 * {x}" for x in names}), "after")
        whole = gram(both_, [*names, *[f"n{x}" for x in names]])
        n = len(names)
        own, mixed, twice = whole[:n, :n], whole[:n, n:], whole[n:, n:]
        # Rayleigh-Ritz in the space of the columns, which the first step makes orthonormal.
        scale, turn = np.linalg.eigh(own)
        turn = turn[:, scale > 1e-13 * scale.max()] / np.sqrt(scale[scale > 1e-13 * scale.max()])
        values, more = np.linalg.eigh(turn.T @ (mixed + mixed.T) @ turn / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn @ more[:, order]
        left = [float(np.sqrt(max(0.0, turn[:, j] @ (twice - values[j] * (mixed + mixed.T) + values[j] ** 2 * own) @ turn[:, j]))) for j in range(1, k + 1)]
        names, old, upto = names[: turn.shape[1]], names, min(0.999, max(0.1, float(values[-1])))
        state = both_.select("node", *[sum((F.col(x) * float(turn[i, j]) for i, x in enumerate(old)), F.lit(0.0)).alias(name) for j, name in enumerate(names)])
        if max(left) < tolerance:
            break
    state = scratch.keep(state, "map")
    largest = lambda x: F.max_by(F.signum(x), F.struct(F.round(F.abs(x), 9), -F.col("node")))
    signs = state.agg(*[largest(f"x{j}").alias(f"s{j}") for j in range(1, k + 1)]).first()
    return state.select("node", *[(F.col(f"x{j}") * float(signs[j - 1] or 1.0)).alias(f"x{j}") for j in range(1, k + 1)])


def gram(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The products of all pairs of columns, summed over the rows: one small row comes to the driver."""
    upper = [(i, j) for j in range(len(names)) for i in range(j + 1)]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in upper]).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), x in zip(upper, sums, strict=True):
        out[i, j] = out[j, i] = x or 0.0
    return out
