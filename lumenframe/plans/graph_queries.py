"""Queries: neighbours of whole tables, the weighted neighbour graph, communities, spread labels, a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, nearest_index
from .registry import query
from .standins import points

#: Points that a neighbourhood holds, the point itself included.
SIZE = 15
NEAR = f"""every AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z FROM embeddings), dd AS (SELECT a.id, b.id AS nid, list_distance(a.z, b.z) AS d FROM every a JOIN every b ON a.id <> b.id),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS r FROM dd QUALIFY r < {SIZE})"""
#: The bandwidth by {HALVINGS} halvings of its bracket, as the operator finds it.
FUZZY = f"""lists AS (SELECT id, list(d ORDER BY d, nid) AS ds, list(nid ORDER BY d, nid) AS ns FROM nn GROUP BY 1),
above AS (SELECT *, list_transform(ds, lambda x: greatest(x - coalesce(list_min(list_filter(ds, lambda y: y > 0)), 0), 0)) AS up FROM lists),
widths AS (SELECT *, list_reduce(list_concat([{{'lo': 0::DOUBLE, 'hi': 'inf'::DOUBLE, 'mid': 1::DOUBLE}}], list_transform(range({graph.HALVINGS}), lambda i: {{'lo': 0::DOUBLE, 'hi': 0::DOUBLE, 'mid': 0::DOUBLE}})),
  lambda s, i: CASE WHEN list_sum(list_transform(up, lambda x: exp(-x / s.mid))) > log2({SIZE}) THEN {{'lo': s.lo, 'hi': s.mid, 'mid': (s.lo + s.mid) / 2}}
  ELSE {{'lo': s.mid, 'hi': s.hi, 'mid': CASE WHEN isinf(s.hi) THEN 2 * s.mid ELSE (s.mid + s.hi) / 2 END}} END).mid AS w FROM above),
strengths AS (SELECT id, unnest(ns) AS nid, unnest(list_transform(up, lambda x: exp(-x / greatest(w, {graph.LEAST_BANDWIDTH} * list_avg(ds))))) AS s FROM widths),
fuzzy AS (SELECT least(id, nid) AS a, greatest(id, nid) AS b, CASE WHEN count(*) > 1 THEN sum(s) - product(s) ELSE sum(s) END AS weight FROM strengths GROUP BY 1, 2)"""


def neighbours(spark, d):
    return nearest_index.nearest_of_all(points(spark, d), SIZE - 1)


def fuzzy(spark, d):
    return graph.fuzzy_graph(neighbours(spark, d), SIZE)


@query(f"WITH {NEAR} SELECT id, nid AS neighbour, r AS rank, round(d, 9) AS distance FROM nn")
def whole_table_neighbours(spark, d):
    """The nearest neighbours of every vector among all."""
    return neighbours(spark, d).withColumn("distance", F.round("distance", 9))


@query(f"WITH {NEAR}, {FUZZY} SELECT a, b, round(weight, 6) AS weight FROM fuzzy")
def fuzzy_neighbour_graph(spark, d):
    return fuzzy(spark, d).withColumn("weight", F.round("weight", 6))


@query()
def community_detection(spark, d):
    """Communities of the weighted graph of all vectors at several resolutions; tests hold them against a search in one task."""
    return graph.communities(fuzzy(spark, d), [0.2, 0.4, 0.8])


ROUNDS = 6
_ROUND = "s{k} AS (SELECT node, label, sum(part) AS share FROM (SELECT a AS node, label, 0.9 * step * share AS part FROM steps JOIN s{j} ON b = node UNION ALL SELECT node, label, (1 - 0.9) * share FROM s0) GROUP BY 1, 2)"


@query(f"""WITH {NEAR}, {FUZZY}, e AS (SELECT a, b, weight FROM fuzzy WHERE weight > 0 UNION ALL SELECT b, a, weight FROM fuzzy WHERE weight > 0), deg AS (SELECT a AS node, sum(weight) AS d FROM e GROUP BY 1),
steps AS (SELECT e.a, e.b, weight / sqrt(x.d * y.d) AS step FROM e JOIN deg x ON e.a = x.node JOIN deg y ON e.b = y.node), seeds AS (SELECT vec_id AS node, 'L' || label AS label FROM embeddings WHERE vec_id % 20 = 0),
s0 AS (SELECT node, label, 1 / (count(*) OVER (PARTITION BY label))::DOUBLE AS share FROM seeds), {", ".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1))}
SELECT node AS id, label, round(share / sum(share) OVER (PARTITION BY node), 8) AS share FROM s{ROUNDS}""")
def spread_label_shares(spark, d):
    """A twentieth of the labels spread over the weighted graph of all vectors; a class weighs as much as another, however many it has."""
    named = points(spark, d).select("id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("label")).where("id % 20 = 0")
    weights = named.groupBy("label").agg((1 / F.count(F.lit(1))).alias("weight"))
    shares = graph.spread_labels(fuzzy(spark, d), named, weights=weights, rounds=ROUNDS, node="id")
    return shares.withColumn("share", F.round("share", 8))


@query()
def spectral_layout(spark, d):
    """Two coordinates of every vector, from the weighted graph; a test bounds the residual."""
    return graph.spectral_map(fuzzy(spark, d))
