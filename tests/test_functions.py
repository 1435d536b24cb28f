import json

import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.config import Settings
from lumenframe.functions import numbers, text
from lumenframe.operators import attribution, classify, compose, distance, evidence, expression, graph, markers, neighbors, qc, recode, review, sampling, vocabulary
from lumenframe.sources import readers, sinks


def one(spark, c, **values):
    schema_ = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema_).select(c.alias("x")).first().x


def test_guards(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("10", 3), ("2", 4)], "k string, v int")
    with pytest.raises(KeyError, match="z"):
        schema.require_columns(df, "k", "z")
    assert schema.first_present(df, ["q", "v", "k"]) == "v"
    with pytest.raises(ValueError):
        schema.require_unique(df, "k")
    assert sorted(r.k for r in schema.suffix_duplicates(df, "k", ["v"]).collect()) == ["10", "2", "a", "a-1"]
    assert [r.k for r in df.orderBy(*schema.numeric_order("k")).collect()] == ["2", "10", "a", "a"]


def test_settings():
    s = Settings().with_changes(seed=3)
    assert json.loads(s.to_json())["seed"] == 3 and Settings().seed == 0


@pytest.mark.parametrize(("raw", "label", "note"), [("Mature Cytotoxic review", "Mature Cytotoxic", "review"), ("mature cytotoxic tcf7+ low", "Mature Cytotoxic TCF7+", "low"), ("X review: a; b", "X", "a; b"), (" T ", "T", ""), ("Tx", "Tx", ""), ("", "", ""), ("B odd review", "B", "odd; review"), (None, None, None)])
def test_draft_labels(spark, raw, label, note):
    got = spark.createDataFrame([(raw,)], "r string").select(*text.split_draft_label(F.col("r"), vocabulary.REFINED_LABELS)).first()
    assert (got[0], got[1]) == (label, note) or raw is None and got[0] is None


def test_text(spark):
    assert one(spark, text.combine_notes(F.col("a"), F.col("b")), a="x; y;x", b="nan") == "x; y"
    assert one(spark, text.humanise(F.col("a"), vocabulary.NOTE_WORDS), a="high_assay_specificity,odd;odd") == "mostly from one assay; odd"
    assert one(spark, text.ids_in(F.col("a"), F.lit(["1", "12"])), a="12 vs 3, 1 and 12 v1") == ["12", "1"]
    assert one(spark, text.safe_name(F.col("a")), a=" A+B / c__d ") == "AplusB_c_d"
    assert one(spark, text.shown_number(F.col("a"), 1), a="2.25") == "2.2" and one(spark, text.shown_number(F.col("a"), 1), a="q") == "NA"


def test_numbers(spark):
    assert [one(spark, numbers.score_0_to_5(F.col("a")), a=x) for x in ("2.5", "3.5", "9", "-1", "x", "NaN")] == [2, 4, 5, 0, 0, 0]
    p = F.array(*[F.lit(x) for x in (0.25, 0.25, 0.25, 0.25)])
    assert one(spark, numbers.certainty(p), a=1) == pytest.approx(0, abs=1e-9)
    assert one(spark, numbers.first_of_largest(p, F.lit(["a", "b", "c", "d"])), a=1) == "a"
    assert one(spark, numbers.two_sided_normal(F.col("a")), a=1.959964) == pytest.approx(0.05, abs=1e-6)
    rows = spark.createDataFrame([(1.0, None, 7.0), (3.0, 5.0, 7.0), (2.0, None, 7.0)], "a double, b double, c double")
    got = rows.select(numbers.min_max_scaled(F.col("a")).alias("a"), numbers.min_max_scaled(F.col("b"), lower_is_better=True).alias("b"), numbers.min_max_scaled(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.5, 1.0, 1.0)]


def test_assays_and_merging(spark):
    got = spark.createDataFrame([(None,), ("nan",), ("None",), ("",), ("v2",)], "a string").select(recode.clean_assay(F.col("a"), "Flex").alias("x")).collect()
    assert [r.x for r in got] == ["Flex", "Flex", "None", "", "v2"]
    rows = [("d1", "a")] * 5 + [("d1", "b")] * 2 + [("d2", "x")] + [("d2", "y")]
    merged = compose.merge_rare_assays(spark.createDataFrame(rows, "d string, a string"), "d", "a", "m", 3)
    assert sorted((r.d, r.a, r.m) for r in merged.distinct().collect()) == [("d1", "a", "a"), ("d1", "b", "a"), ("d2", "x", "x"), ("d2", "y", "x")]
    with pytest.raises(ValueError, match="2, 10, q"):
        recode.map_strict(spark.createDataFrame([("1",), ("10",), ("q",), ("2",)], "c string"), "c", {"1": "one"}, "l")
    with pytest.raises(ValueError, match=", and others$"):
        recode.map_strict(spark.range(150).selectExpr("CAST(id AS string) AS c").toDF("c"), "c", {"0": "one"}, "l", named=148)
    with pytest.raises(ValueError, match="149$"):
        recode.map_strict(spark.range(150).selectExpr("CAST(id AS string) AS c"), "c", {"0": "one"}, "l")
    with pytest.raises(ValueError):
        recode.class_summary(merged, "a", mode="odd")


def test_tied_purity_takes_the_smallest(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "a"), ("1", "b"), ("2", None)], "g string, c string")
    got = {r.g: (r.top_c, r.top_c_frac) for r in compose.top_category(df, "g", "c").collect()}
    assert got == {"1": ("a", 0.5), "2": ("nan", 1.0)}
    wide = {r.g: (r.top_c, r.top_c_frac, r.n_cells) for r in compose.cluster_summary(df, "g", ["c"]).collect()}
    assert wide == {"1": ("a", 0.5, 4), "2": ("nan", 1.0, 1)}


def test_sampling_is_exact_whatever_the_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 5 == 0, F.lit("a")).otherwise(F.lit("b")).alias("l"))
    ranks = {r.k: r.n for r in sampling.hash_ranked(df, ["l"], "k", 1, "n").collect()}
    for part in ("a", "b"):
        mine = [k for k in ranks if (k % 5 == 0) == (part == "a")]
        assert sorted(ranks[k] for k in mine) == list(range(1, len(mine) + 1))
    caps = {"a": 30}
    picked = [sorted(r.k for r in sampling.cap_classes(d, "l", "k", caps).collect()) for d in (df, df.repartition(7), df.coalesce(1))]
    assert picked[0] == picked[1] == picked[2] and len(picked[0]) == 430
    assert sampling.major_ratio(df.where("l = 'a'"), "l", "k", "a").count() == 100  # nothing else: no cut
    split = sampling.stratified_split(df, "l", "k", F.col("k") < 100)
    assert {(r.l, r.split): r["count"] for r in split.groupBy("l", "split").count().collect()} == {("a", "Held-out"): 20, ("b", "Held-out"): 80, ("a", "Val"): 16, ("a", "Train"): 64, ("b", "Val"): 64, ("b", "Train"): 256}
    assert sampling.proportional_sample(df, "l", "k", 50).count() == 50


def test_null_labels_and_marks_are_rows_like_any_other(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, "b").otherwise("a").alias("l"))
    cut = sampling.major_ratio(df, "l", "k", "a", 0.5)
    assert {r.l: r["count"] for r in cut.groupBy("l").count().collect()} == {None: 50, "b": 50, "a": 50}
    held_out = F.when(F.col("k") < 13, F.col("k") < 3)  # null from 13 on
    split = sampling.stratified_split(df, "l", "k", held_out)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"Held-out": 3, "Val": 40, "Train": 157}


@pytest.mark.parametrize("sizes", [[1, 1, 1], [7, 5, 3, 1, 1, 1], [3, 3, 3, 3, 3, 2], [50]])
def test_validation_part_is_exact(spark, sizes):
    """As many rows in all as are asked for, each label within one of its share."""
    rows = [(i, f"l{k}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    split = sampling.stratified_split(spark.createDataFrame(rows, "k long, l string"), "l", "k", F.lit(False))
    found = {r.l: r.n for r in split.groupBy("l").agg(F.count_if(F.col("split") == "Val").alias("n")).collect()}
    assert sum(found.values()) == -(-len(rows) // 5) and all(abs(found[f"l{k}"] - n / 5) <= 1 for k, n in enumerate(sizes))


def test_balance_of_a_balanced_table_changes_nothing(spark):
    rows = [(i, "AAAB"[i % 4], f"b{i % 3}", 50.0 + i % 200, i % 29 == 0) for i in range(600)]
    cells = spark.createDataFrame(rows, "cell_id long, label string, batch string, library double, safe boolean")
    balance = lambda df: qc.qc_balance(df, label="label", batch="batch", protected=F.col("safe"), low=60.0, high=240.0, min_class=20, caps={"A": 300}, major="A", ratio=1.5, min_batch=30)
    once = balance(cells)
    assert sorted(map(tuple, balance(once).collect())) == sorted(map(tuple, once.collect())) and 0 < once.count() < 600


def test_library_bounds(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    counts = spark.createDataFrame([(1, "g", 5.0), (1, "h", 5.0), (2, "g", 3.0)], "cell_id long, gene string, count double")
    sized = qc.library_sizes(cells, counts)
    assert {r.cell_id: r.library for r in sized.collect()} == {1: 10.0, 2: 3.0, 3: 0.0}
    assert {r.cell_id for r in qc.library_range(sized, low=3.0, high=10.0).collect()} == {1, 2}
    with pytest.raises(ValueError):
        qc.library_range(sized)


def test_rank_sum_equals_dense_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.poisson(0.7, (40, 5)).astype(float)
    x[:, 3], x[:, 4] = 0, 2
    group = ["a" if i % 3 else "b" for i in range(40)]
    cells = spark.createDataFrame(list(enumerate(group)), "cell_id long, g string")
    coo = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(5) if x[i, j] > 0], "cell_id long, gene string, x double")
    got = {(r.g, r.gene): r.z for r in markers.rank_sum(coo, cells, "g").collect()}
    for j in range(3):
        v = x[:, j]
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        t = np.unique(v, return_counts=True)[1].astype(float)
        spread = 1 - ((t**3 - t).sum()) / (40**3 - 40)
        for g in "ab":
            m = np.array([h == g for h in group])
            n = m.sum()
            z = (rank[m].sum() - n * 41 / 2) / np.sqrt(spread * n * (40 - n) * 41 / 12)
            assert got[g, f"g{j}"] == pytest.approx(z)
    assert got["a", "g4"] is None and ("a", "g3") not in got
    means = {(r.g, r.gene): r.mean for r in expression.group_means(coo, cells, "g").collect()}
    assert means["a", "g0"] == pytest.approx(x[np.array([h == "a" for h in group]), 0].mean())


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.04,), (None,), (0.5,)], "p double")
    got = {r.p: round(r.q, 6) for r in markers.adjusted(df, "p", to="q").where("p IS NOT NULL").collect()}
    assert got == {0.01: 0.05, 0.03: 0.05, 0.04: 0.05, 0.5: 0.5}


def test_classification_edges(spark):
    rows = [("a", "a")] * 3 + [("a", "c")] + [("b", "a")] * 2 + [("Unknown", "a")] * 5 + [("rare", "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    kept = classify.scored_rows(df, "t", by=[], fewest=2)
    got = {r["class"]: (r.n_true, r.precision, r.recall, r.f1) for r in classify.per_class(kept, "t", "p").collect()}
    assert got == {"a": (4, 0.6, 0.75, pytest.approx(2 / 3)), "b": (2, 0.0, 0.0, 0.0)}
    every = {r["class"]: r.n_true for r in classify.per_class(kept, "t", "p", predicted_only=True).collect()}
    assert every == {"a": 4, "b": 2, "c": 0}
    s = classify.summary(classify.per_class(kept, "t", "p")).first()
    assert s.macro_f1 == pytest.approx(1 / 3) and s.weighted_f1 == pytest.approx(4 / 9)
    none = classify.summary(classify.per_class(kept.limit(0), "t", "p")).first()
    assert none.macro_f1 is None and none.n_classes == 0


def test_neighbours_with_equal_points(spark):
    pts = spark.createDataFrame([(i, [0.0, 0.0], "ab"[i % 2]) for i in range(6)], "id long, z array<double>, l string")
    near = {(r.id, r.rank): r.neighbour for r in neighbors.nearest(pts, 2).collect()}
    assert near[0, 1] == 1 and near[0, 2] == 2 and near[3, 1] == 0
    blobs = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 0.0], "ab"[i % 2], "xy"[i % 4 > 1]) for i in range(40)], "id long, z array<double>, l string, b string")
    assert neighbors.label_accuracy(blobs, 5, "l").first()[0] == 1.0
    assert neighbors.label_asw(blobs, "l").first()[0] > 0.95
    assert neighbors.graph_connectivity(blobs, 6, "l").first()[0] == 1.0
    assert neighbors.label_accuracy(blobs.withColumn("l", F.lit("a")), 5, "l").first()[0] is None
    assert 0 <= neighbors.batch_asw(blobs, "l", "b").first()[0] <= 1
    got = spark.createDataFrame([(0.9, 1.0), (0.4, 0.5), (None, 0.5), (0.75, 0.5)], "a double, b double").select(neighbors.mixing_score(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 1.0, None, 0.5]
    assert classify.agreement(blobs, "l", "l").first().nmi == pytest.approx(1)


def test_islands_lower_connectivity(spark):
    at = [0.0, 0.1, 0.2, 50.0, 50.1, 50.2, 100.0, 100.1, 100.2]
    pts = spark.createDataFrame([(i, [x], "a" if i < 6 else "b") for i, x in enumerate(at)], "id long, z array<double>, l string")
    assert neighbors.graph_connectivity(pts, 2, "l").first()[0] == pytest.approx(0.75)


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(0, 10, 1.0)]
    for df in (spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(edges[::-1], "a long, b long, weight double").repartition(3)):
        got = {r.node: r.cluster for r in graph.communities(df, [1.0]).collect()}
        assert len(set(got.values())) == 2 and len({got[i] for i in range(5)}) == 1


def test_distances_and_novelty(spark):
    latent = spark.createDataFrame([("1", [0.0, 0.0]), ("1", [2.0, 0.0]), ("2", [1.0, 3.0]), ("10", [1.0, 0.5]), ("3", [9.0, 9.0])], "c string, z array<float>")
    d = distance.centroid_distances(latent, "c", "z")
    got = {(r.cluster_a, r.cluster_b): r.centroid_distance for r in d.collect()}
    assert ("2", "10") in got and ("10", "2") not in got and got["1", "2"] == pytest.approx(3.0)
    labels = spark.createDataFrame([("1", "T", None), ("2", "T", "new"), ("10", "B", None), ("3", "B", None)], "cluster string, label string, alternative string")
    e = {r.cluster: r for r in distance.novelty_evidence(d, labels).collect()}
    assert e["1"].nearest_cluster == "10" and not e["1"].same_label_distance_flag and e["3"].same_label_distance_flag and e["3"].novelty_score >= 3
    compat = {r.cluster: r for r in distance.novelty_evidence(d, labels, compat=True).collect()}
    assert all(r.same_label_distance_flag for r in compat.values())


def test_related_groups_take_null_as_equal(spark):
    g = spark.createDataFrame([("1", None, "x", ["A"]), ("2", None, "y", ["b"]), ("3", "T", "x", ["C"])], "cluster string, label string, draft string, genes array<string>")
    got = {(r.cluster, r.other): r.score for r in evidence.related_groups(g).collect()}
    assert got == {("1", "2"): 1.0, ("2", "1"): 1.0, ("1", "3"): 1.0, ("3", "1"): 1.0}


def test_decisions_and_queues(spark):
    df = spark.createDataFrame([(1, 'so {"candidate_label": "Odd", "concerns": "maybe Regulatory"} end'), (2, "none")], "cluster long, decision string")
    got = {r.cluster: r for r in review.normalised(df, audit=None).collect()}
    assert got[1].candidate_label == "Regulatory" and got[1].suggested_new_label == "Odd" and got[1].needs_human_review
    assert got[2].candidate_label == "Mature Cytotoxic" and got[2].confidence_score == 0
    q = [spark.createDataFrame(x, "a string, b string, place int") for x in ([("10", "2", 1), ("1", "3", 2)], [("2", "10", 1), ("4", "5", 2)])]
    assert [(r.cluster_a, r.cluster_b) for r in review.merged_queue(q, 2).orderBy("place").collect()] == [(2, 10), (1, 3)]
    texts = spark.createDataFrame([("3", ["3 vs 12", "and 1, 99"]), ("1", ["3"])], "c string, t array<string>")
    assert [(r.cluster_a, r.cluster_b) for r in review.recommended_pairs(texts, "t", "c", ["1", "3", "12"]).orderBy("place").collect()] == [("1", "3"), ("3", "12")]


def test_attribution_selection(spark):
    rows = [("s", f"g{i:02d}", float(100 - i), float(100 - i), 1) for i in range(30)]
    table = attribution.ranked(spark.createDataFrame(rows, "state string, gene string, mean_attr double, mean_abs_attr double, n_cells int"))
    assert attribution.relative_to_top(table, share=0.95, fewest=2, most=50).count() == 6
    assert attribution.relative_to_top(table, share=1.0, fewest=10, most=50).count() == 10
    assert [one(spark, attribution.broad_gene(F.col("g")), g=g) for g in ("mt-co1", "HBB", "HBBX", "RPSA", "CD3E", "HBA2")] == [True, True, False, True, False, True]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "cell_id string, v int")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/c", "cell_id string, v int").collect())) == [("a", 1), ("b", 2)]
    sinks.write_id_list(df, f"{tmp_path}/ids")
    assert [r.cell_id for r in readers.read_id_list(spark, f"{tmp_path}/ids", df.where("v = 2")).collect()] == ["b"]
    (tmp_path / "x.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n')
    assert sorted(map(tuple, readers.read_json_lines(spark, f"{tmp_path}/x.jsonl", "k string, v int", key="k").collect())) == [("a", 3), ("b", 2)]
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/r_3_vs_12_top50_per_group.csv").write_text("names,scores\nA,1.5\n")
    got = readers.read_nested_csvs(spark, f"{tmp_path}/deep", "_per_group.csv", r"_(\d+)_vs_(\d+)_top\d+_per_group\.csv$", ["a", "b"], "names string, scores double").collect()
    assert [tuple(r) for r in got] == [("A", 1.5, "3", "12")]
    with pytest.raises(ValueError):
        readers.aligned(df, df.where("v = 1").select("cell_id", F.lit(1).alias("w")), "cell_id")
    sinks.write_set({"obs": df}, f"{tmp_path}/set")
    assert readers.read_tables(spark, f"{tmp_path}/set", "obs")[0].count() == 2
