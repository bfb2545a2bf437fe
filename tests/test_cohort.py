"""Checks, sinks and tables of a study on hand-sized cases."""

import json

import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from gaitwright.operators import cohort as H
from gaitwright.operators import contracts as P
from gaitwright.operators import estimators as E
from gaitwright.operators import splits as G
from gaitwright.operators import textscores as X
from gaitwright.sources import files


def test_one_to_one_joins_say_what_is_wrong(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, x double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id int, y double")
    assert H.one_to_one(a, b, ["id"]).count() == 2
    for bad in (b.filter("id = 1"), b.union(b)):
        with pytest.raises(ValueError):
            H.one_to_one(a, bad, ["id"])


def test_splits_of_a_manifest(spark, tmp_path):
    split = spark.createDataFrame([(0, "train", "a"), (0, "test", "b"), (1, "train", "b"), (1, "test", "c")], "fold int, role string, s string")
    rows = spark.createDataFrame([("a",), ("b",)], "s string")
    assert sorted(map(tuple, P.union_faults(split, rows, "s").collect())) == [(1, "a"), (1, "c")]
    with pytest.raises(ValueError):
        H.with_auxiliary(split, spark.createDataFrame([("c",)], "s string"), "s")
    with pytest.raises(ValueError):
        H.partition_of(split, 0, "validation")
    assert [r.s for r in H.partition_of(split, 1, "test").collect()] == ["c"]
    files.write_split(split, f"{tmp_path}/split", "s", seed=7)
    read = {r.fold: r for r in spark.read.json(f"{tmp_path}/split").collect()}
    assert read[0].train_subjects == ["a"] and read[1].test_subjects == ["c"] and read[0].seed == 7
    assert G.split_mode("auto", 2, 3) == "trial" and G.split_mode("auto", 3, 3) == "subject"
    with pytest.raises(ValueError):
        G.split_mode("subject", 2, 3)


def test_folds_near_their_shares(spark):
    """Two heavy and four light subjects of two classes: each of two folds gets one heavy one."""
    rows = [(i, 10 if i < 2 else 1, "x" if i % 2 else "y", 1.0) for i in range(6)]
    stats = spark.createDataFrame(rows, "s int, samples int, c string, rarity double")
    got = {r.s: r.fold for r in G.balanced_folds(stats, "s", 2, ["c"]).collect()}
    assert got[0] != got[1] and sorted(got.values()) == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        G.balanced_folds(stats, "s", 7, ["c"])


def test_manifest_and_recordings(spark, tmp_path):
    head = "subject_id,trial_id,task_id,trial_number,fma_score,eeg_path,emg_path\n"
    (tmp_path / "ok.csv").write_text(head + "10,a,2,1,5,e,m\n9,b,1,2,6,e,m\n10,c,1,1,5,e,m\n")
    rows = files.read_manifest(spark, f"{tmp_path}/ok.csv")
    assert [r.trial_id for r in files.manifest_order(rows).collect()] == ["b", "c", "a"]
    assert {r.subject_id: r.samples for r in files.subject_stats(rows, ["fma_score"]).collect()} == {"10": 2, "9": 1}
    (tmp_path / "bad.csv").write_text(head + "10,a,2,1,5,e,m\n10,c,1,1,6,e,m\n")
    with pytest.raises(ValueError, match="changing"):
        files.read_manifest(spark, f"{tmp_path}/bad.csv")
    for name, n in (("one", 5), ("two", 3)):
        (tmp_path / f"{name}.eeg.csv").write_text("C3,C4,M1\n" + "".join(f"{i},{i * 2},0\n" for i in range(n)))
    got = files.read_channels(spark, f"{tmp_path}/*.eeg.csv", ["C3", "C4"]).collect()
    for name, n in (("one", 5), ("two", 3)):
        own = sorted((r.idx, r.value) for r in got if name in r.path and r.channel == "C4")
        assert own == [(i, 2.0 * i) for i in range(n)]
    listing = files.list_files(spark, f"{tmp_path}")
    here = rows.withColumn("p", F.when(F.col("trial_id") == "a", listing.select("path").first().path).otherwise("none"))
    assert [r.trial_id for r in files.with_files(here, listing, "p").collect()] == ["a"]
    keys = files.file_keys(listing, rate=500).collect()
    assert len({r.key for r in keys}) == len(keys) and {r.key for r in keys} != {r.key for r in files.file_keys(listing, rate=200).collect()}


def test_reference_free_recordings(spark):
    rows = [("f", i, c, float(i % 7) * k) for i in range(400) for c, k in (("C3", 1), ("C4", 3), ("M1", 9))]
    df = spark.createDataFrame(rows, "path string, idx long, channel string, value double")
    out = files.reference_free(df, ["M1"], 200.0, 100.0).collect()
    assert {r.channel for r in out} == {"C3", "C4"} and len(out) == 2 * 201
    pair = {(r.channel, r.k): r.value for r in out}
    assert all(pair["C3", k] == pytest.approx(-pair["C4", k], abs=1e-9) for k in range(201))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("FMA", "mae", 1.0), ("tone", "f1", 0.5)], "task string, metric string, value double")
    files.write_figure_tables(rows, f"{tmp_path}", {"fig": (["FMA"], ["mae"])})
    assert spark.read.option("header", True).csv(f"{tmp_path}/fig").count() == 1
    with pytest.raises(ValueError):
        files.write_figure_tables(rows, f"{tmp_path}", {"none": (["BI"], ["mae"])})
    files.write_class_tables(spark.createDataFrame([(0, 1, 1), (0, 0, 0)], "fold int, y_true int, y_pred int"), ["fold"], ["0", "1+"], f"{tmp_path}/c")
    assert {r.label: r.recall for r in spark.read.json(f"{tmp_path}/c/classes").collect()} == {"0": 1.0, "1+": 1.0}
    assert spark.read.option("header", True).csv(f"{tmp_path}/c/confusion").columns == ["fold", "y_true", "0", "1+"]
    once = files.held_table(rows, f"{tmp_path}", "k")
    assert files.held_table(rows.limit(0), f"{tmp_path}", "k") is once and once.count() == 2
    files.release_tables()
    assert files.held_table(rows.limit(0), f"{tmp_path}", "k").count() == 2
    files.release_tables()


def test_baselines_over_folds(spark, tmp_path):
    rows = [(i, i % 2, float(i % 3), [float(i % 3), float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, fold int, y double, x array<double>")
    out, metrics = E.run_folds("ridge", df, "y", "fold", [0, 1], "regression", tolerance=0.5)
    assert out.count() == 30 and metrics.count() == 2
    out, metrics = E.run_folds("logistic", df, "y", "fold", [0, 1], "classes", 3)
    assert all(r.prob_c0 + r.prob_c1 + r.prob_c2 == 1 for r in out.collect()) and metrics.agg(F.min("accuracy")).first()[0] > 0.6
    ready = E.standardised(df, df)
    assert R.LinearRegression(featuresCol="features", labelCol="y").fit(ready).numFeatures == 2
    edges = {tuple(r) for r in E.chain_edges(spark, [2, 4], paired=[(0, 1)], per=2).collect()}
    assert {(0, 1), (2, 3), (0, 2), (0, 3), (1, 4), (1, 5), (5, 1)} <= edges and (0, 4) not in edges


def test_reviews(spark):
    reports = spark.createDataFrame([(s, m, f"text {s}") for s in (10, 9, 2) for m in ("u", "v")], "subject int, system string, report string")
    packet, key = X.review_tables(reports, "subject", "system", 3, ["report"], [])
    assert packet.columns == ["review_id", "case_code", "report"] and key.columns == ["review_id", "case_code", "system", "subject"]
    codes = {r.subject: r.case_code for r in key.collect()}
    assert codes == {2: "C001", 9: "C002", 10: "C003"} and len({r.review_id for r in key.collect()}) == 6
    assert X.repeated_reports(reports.union(reports.limit(1)), "subject", "system").count() == 1
    told = files.rendered_json(spark.createDataFrame([(1, "a")], "x int, y string")).first().json
    assert json.loads(told) == {"x": 1, "y": "a"}
