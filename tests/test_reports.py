import pytest
from pyspark.sql import functions as F

from lumenframe.operators import bundles, markers, reports, review, selection
from lumenframe.sources import readers, sinks


def test_newest_round_and_suffix():
    paths = ["a/round_2/x.csv", "a/round_10/x.csv", "a/round_3/y.csv"]
    assert readers.newest_round(paths, "x.csv") == "a/round_10/x.csv" and readers.newest_round([*paths, "a/x.csv"], "x.csv") == "a/x.csv" and readers.newest_round([], "x.csv") is None
    assert selection.filter_suffix(True, exclude=["a", "b"]) == "_known_assays_only_exclude_a_b" and selection.filter_suffix() == ""


def test_arrays_and_traces_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, [0.5, 1.0]), (0, [1.5, 2.0]), (1, [3.0, 4.0])], "id long, z array<float>")
    sinks.write_npz(rows, f"file://{tmp_path}/z.npz")
    assert sorted(tuple(r) for r in readers.read_npz(spark, f"file://{tmp_path}/z.npz", "z").collect()) == sorted(tuple(r) for r in rows.collect())
    folder = f"file://{tmp_path}/trace"
    sinks.write_trace(spark.createDataFrame([("a", 1)], "cluster string, n int"), folder, "cluster")
    sinks.write_trace(spark.createDataFrame([("a", 2), ("b", 3)], "cluster string, n int"), folder, "cluster")
    assert sorted((r.cluster, r.n) for r in spark.read.json(folder).collect()) == [("a", 1), ("b", 3)]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        readers.require_path(spark, f"{tmp_path}/nowhere")


def test_strict_codes_name_what_they_lack(spark):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "v string")
    assert [r.c for r in selection.encoded(df.where("v = 'a'"), "v", ["b", "a"], "c").collect()] == [1]
    with pytest.raises(ValueError, match="null, x"):
        selection.encoded(df, "v", ["a"], "c")


def test_results_are_kept_by_settings(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert bundles.kept(spark, str(tmp_path), {"k": 1}, make, needed=("id",), force=force).count() == 3
    assert len(made) == 2


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert review.with_retries(call, sleep=waits.append) == 7 and waits == [1.0, 2.0]


def test_p_values_against_known_ones(spark):
    known = {0.0: 1.0, 1.0: 0.31731050786291415, 1.96: 0.04999579029644087, 3.0: 0.0026997960632601866, 6.0: 1.9731752900753e-09, 10.0: 1.523970604832094e-23}
    rows = spark.createDataFrame([(z,) for z in known] + [(None,)], "z double")
    for r in markers.with_p_values(rows).collect():
        assert r.p == (None if r.z is None else pytest.approx(known[r.z], rel=1e-9))


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert reports.markdown_table(df) == "| x | y |\n| --- | --- |\n| a\\|b |  |"
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(3), most=2)
    assert spark.range(1).select(reports.plural(F.lit(1), "row").alias("a"), reports.plural(F.lit(1200), "row").alias("b")).first() == ("1 row", "1,200 rows")
