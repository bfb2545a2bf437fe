"""Transforms by name and table functions of SQL against the DataFrame functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.functions import tables as TF
from gaitwright.operators import alignment as L
from gaitwright.operators import kernels as K
from gaitwright.operators import series as S


@pytest.fixture(scope="module")
def signals(spark):
    r = np.random.default_rng(8)
    rows = [(s, m, f"{m}{c}", i, float(v)) for s, n in (("x", 90), ("y", 60)) for m, k in (("eeg", 2), ("emg", 2), ("imu", 3)) for (i, c), v in np.ndenumerate(r.normal(size=(n, k)))]
    rows += [("z", "eeg", "eeg0", i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, modality string, channel string, idx int, value double").repartition(7)
    df.createOrReplaceTempView("test_signals")
    TF.register(spark)
    return df


def test_transforms_by_name(spark, signals):
    one = signals.filter("channel = 'eeg0'")
    got = one.transform(TF.by_name("z_score", by=["series"], value="value", name="z")).collect()
    want = S.z_score(one, ["series"], "value", "z").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert one.transform(TF.by_name("clean_imu", by=["series"], value="value", rate=100.0)).count() == one.count()
    with pytest.raises(ValueError, match="no transform"):
        TF.by_name("other")


def test_table_functions_equal_frames(spark, signals):
    sql = "SELECT * FROM gait_band_powers(TABLE(SELECT series, idx, value, 200.0 AS rate FROM test_signals WHERE channel = 'eeg0') PARTITION BY series)"
    got = {r.series: [r[b] for b in K.BANDS] for r in spark.sql(sql).collect()}
    want = {r.series: [r[b] for b in K.BANDS] for r in K.spectral_features(signals.filter("channel = 'eeg0'"), ["series"], "value", 200.0).collect()}
    assert got.keys() == want.keys() == {"x", "y", "z"} and all(got[k] == pytest.approx(want[k]) for k in got)
    trials = L.trial_rows(signals, ["series"])
    told = {r.series: r for r in L.aligned_trials(trials, ["series"], "knot").collect()}
    for r in spark.sql("SELECT * FROM gait_knot_alignment(TABLE(SELECT * FROM test_signals) PARTITION BY series)").collect():
        assert [r[c] for c in TF.KnotAlignment.told] == [told[r.series][c] for c in TF.KnotAlignment.told] and (r.warning is None) == (told[r.series].warning is None)
    aligned = spark.sql("SELECT * FROM gait_align(TABLE(SELECT *, 'resample' AS strategy FROM test_signals) PARTITION BY series)")
    plain = {r.series: r for r in L.aligned_trials(trials, ["series"], "resample").collect()}
    assert aligned.select("series").distinct().count() == 2
    for r in aligned.filter("channel = 'imu1'").groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("v")).collect():
        assert r.v == pytest.approx(plain[r.series].imu[1])


def test_lags_as_a_table_function(spark, signals):
    r = np.random.default_rng(1)
    x = r.normal(size=200)
    rows = [("p", "a", i, float(v)) for i, v in enumerate(np.roll(x, 9))] + [("p", "b", i, float(v)) for i, v in enumerate(x)] + [("q", "a", i, 1.0) for i in range(5)]
    spark.createDataFrame(rows, "series string, side string, idx int, value double").createOrReplaceTempView("test_sides")
    got = {r.series: r for r in spark.sql("SELECT * FROM gait_best_lag(TABLE(SELECT *, 20 AS reach FROM test_sides) PARTITION BY series)").collect()}
    assert got["p"].lag == 9 and got["p"].peak > 0.9 and not got["p"].fallback and got["q"].fallback and got["q"].lag == 0
