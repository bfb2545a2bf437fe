"""Saved models, results kept between runs, splits that come back, calibration by group."""

import os

import numpy as np
import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from gaitwright.operators import calibration as CA
from gaitwright.operators import estimators as E
from gaitwright.operators import splits as G
from gaitwright.sources import files
from gaitwright.sources.cache import TrialCache


def numbers(spark, n: int = 90):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 3)) * [1, 10, 0] + [5, -3, 2]
    y = (x[:, 0] > 5).astype(int) + (x[:, 1] > 0)
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y double, x array<double>")


@pytest.mark.parametrize("name", sorted(E.REGISTRY))
def test_saved_models_predict_raw_rows_in_a_new_session(spark, tmp_path, name, monkeypatch):
    smaller = {"forest": ("numTrees", 5), "forest_regression": ("numTrees", 5)}
    if name in smaller:
        make, (key, value) = E.REGISTRY[name], smaller[name]
        monkeypatch.setitem(E.REGISTRY, name, lambda n, **kw: make(n, **kw).copy({}).setParams(**{key: value}))
    if name.startswith("boosted"):
        make = E.REGISTRY[name]

        def shorter(n, **kw):
            stage = make(n, **kw)
            (stage.getClassifier() if name == "boosted_classes" else stage).setMaxIter(4)
            return stage

        monkeypatch.setitem(E.REGISTRY, name, shorter)
    df = numbers(spark)
    model = E.fit(name, df.filter("id % 3 > 0"), "y", (0.0, 2.0))
    want = {q.id: q.y_pred for q in model.transform(df).collect()}
    E.save_model(model, f"{tmp_path}/m", name=name, classes=[0, 1, 2])
    E.save_model(model, f"{tmp_path}/m", name=name, classes=[0, 1, 2], fold=3)  # replaces what was there
    loaded, about = E.load_model(f"{tmp_path}/m")
    assert about == {"name": name, "classes": [0, 1, 2], "fold": 3}
    other = spark.newSession()
    raw = other.createDataFrame([(q.id, q.x) for q in df.collect()], "id int, x array<double>")
    got = {q.id: q.y_pred for q in loaded.transform(raw).collect()}
    assert got == want and set(got) == set(range(90)) and all(0 <= v <= 2 for v in got.values())
    same = E.fit_predict(name, df.filter("id % 3 > 0"), df, "y", (0.0, 2.0)).collect()
    assert {q.id: q.y_pred for q in same} == pytest.approx(want)


def test_a_single_class_and_wrong_widths(spark, tmp_path):
    df = numbers(spark, 20).withColumn("y", F.lit(4.0))
    E.save_model(E.fit("boosted_classes", df, "y"), f"{tmp_path}/one")
    assert {q.y_pred for q in E.load_model(f"{tmp_path}/one")[0].transform(df).collect()} == {4.0}
    model = E.fit("ridge", numbers(spark), "y")
    with pytest.raises(Exception, match="3 features are expected, not 2"):
        model.transform(spark.createDataFrame([([1.0, 2.0],)], "x array<double>")).collect()


def trials(spark, changed: dict):
    return spark.createDataFrame([(i, f"k{i}.{changed.get(i, 0)}") for i in range(100)], "trial int, key string")


def test_only_changed_trials_are_computed_and_cut_files_heal(spark, tmp_path):
    asked = []

    def compute(wanted):
        if not wanted.isEmpty():
            asked.append(sorted(q.trial for q in wanted.collect()))
        return wanted.select("trial", F.concat("key", F.lit("!")).alias("told"), F.array(F.col("trial") * 1.5, F.lit(None).cast("double")).alias("x"))

    def rows(df):
        return {q.trial: (q.told, q.x[0]) for q in df.collect()}

    root = f"{tmp_path}/cache"
    with TrialCache(root, ["trial"], parts=16) as cache:
        want = {i: (f"k{i}.0!", i * 1.5) for i in range(100)}
        assert rows(cache.load(trials(spark, {}), compute)) == want and cache.computed == 100
        assert rows(cache.held(trials(spark, {}), compute)) == want and cache.computed == 0
        assert rows(cache.load(trials(spark, {7: 1}), compute)) == want | {7: ("k7.1!", 10.5)} and asked[-1] == [7]
        assert rows(cache.load(trials(spark, {7: 1}).filter("trial < 9"), compute)).keys() == set(range(9)) and cache.computed == 0
        # A file that is cut short, and one whose bytes are another row's.
        parts = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))
        with open(parts[0], "r+b") as f:
            f.truncate(os.path.getsize(parts[0]) // 2)
        lost = 100 - spark.read.option("ignoreCorruptFiles", True).schema("trial int").parquet(root).count()
        again = cache.load(trials(spark, {7: 1}), compute)
        assert rows(again) == want | {7: ("k7.1!", 10.5)} and cache.computed == lost > 0
        assert cache.load(trials(spark, {7: 1}), compute).count() == 100 and cache.computed == 0
        broken = spark.read.parquet(root).filter("trial = 50").withColumn("told", F.lit("other"))
        broken.write.mode("append").partitionBy("__gw_part").parquet(root)
        assert rows(cache.load(trials(spark, {7: 1}), compute)) == want | {7: ("k7.1!", 10.5)}
    assert not cache._held
    with TrialCache(f"{tmp_path}/none", ["trial"]) as empty:
        assert empty.load(trials(spark, {}).limit(0), compute).count() == 0
        assert empty.load(spark.createDataFrame([(None, "a"), (1, None)], "trial int, key string"), compute).count() == 0


def test_splits_come_back(spark, tmp_path):
    rows = [(k, "test" if i % 3 == k else "validation" if i == (k + 1) % 3 else "train", str(i)) for k in range(3) for i in range(9)]
    split = spark.createDataFrame(rows, "fold int, role string, s string")
    files.write_split(split, f"{tmp_path}/split", "s", seed=7)
    assert sorted(map(tuple, files.read_split(spark, f"{tmp_path}/split").collect())) == sorted(rows)
    assert files.read_split(spark, f"{tmp_path}/split", 2).count() == 9
    subjects = spark.createDataFrame([(str(i),) for i in range(9)], "s string")
    made = []
    make = lambda: made.append(1) or split
    for _ in range(2):
        assert files.ensure_split(f"{tmp_path}/kept", make, spark, "s", subjects, seed=1).count() == 27
    assert len(made) == 1
    with pytest.raises(ValueError, match="both sides"):
        files.ensure_split(f"{tmp_path}/bad", lambda: split.union(spark.createDataFrame([(0, "train", "0")], split.schema)), spark, "s")
    groups = spark.createDataFrame([(g, i) for g, n in (("a", 9), ("b", 3)) for i in range(n)], "g string, k int")
    with pytest.raises(ValueError, match="fewer than 2"):
        G.inner_split(groups, ["g"], "k", 0.2, 3)
    assert G.inner_split(groups.filter("g = 'a'"), ["g"], "k", 0.2, 3).filter("role = 'validation'").count() == 2


def test_isotonic_equals_the_library_for_each_group(spark):
    r = np.random.default_rng(14)
    rows = [(g, float(np.round(x, 1 if g == "b" else 6)), float(x * s + r.normal())) for g, n, s in (("a", 400, 1.0), ("b", 300, 0.3), ("c", 60, -1.0), ("d", 1, 0.0)) for x in r.uniform(0, 9, n)]
    df = spark.createDataFrame(rows, "g string, y_pred double, y_true double")
    asked = spark.createDataFrame([(g, float(x)) for g in "abcd" for x in np.linspace(-1, 10, 67)] + [("a", None), ("a", float("nan")), ("z", 1.0)], "g string, y_pred double")
    blocks = CA.isotonic_blocks(df, ["g"])
    got = CA.isotonic_calibrated(asked, blocks, ["g"]).collect()
    assert len(got) == 4 * 67 + 3 and sum(q.calibrated is None for q in got) == 3
    for g in "abcd":
        model = R.IsotonicRegression(featuresCol="y_pred", labelCol="y_true", predictionCol="c").fit(df.filter(F.col("g") == g))
        want = {q.y_pred: q.c for q in model.transform(asked.filter((F.col("g") == g) & F.col("y_pred").isNotNull() & ~F.isnan("y_pred"))).collect()}
        assert {q.y_pred: q.calibrated for q in got if q.g == g and q.calibrated is not None} == pytest.approx(want, abs=1e-9)
    values = [q.value for q in blocks.filter("g = 'a'").orderBy("low").collect()]
    assert values == sorted(values)
    whole = CA.isotonic_calibrated(asked.drop("g"), CA.isotonic_blocks(df.drop("g"), []), [])
    assert whole.count() == asked.count() and whole.filter("calibrated is null").count() == 2
    assert CA.isotonic_blocks(df.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("name,grid", [("ridge", [{"regParam": r} for r in (0.0, 0.1, 5.0, 500.0, 0.2)]), ("logistic", [{"maxIter": n} for n in (1, 20)])])
def test_validated_choice_follows_its_history(spark, name, grid):
    df = numbers(spark).withColumn("subject", (F.col("id") / 3).cast("int"))
    model, history, choice = E.validated(name, df, "y", "subject", grid, 2, folds=3, seed=1, bounds=(0.0, 2.0))
    rows = sorted(history.collect(), key=lambda q: q.step)
    assert [q.step for q in rows] == list(range(1, len(grid) + 1)) and [eval(q.settings) for q in rows] == grid
    got = choice.first()
    best, last = None, len(rows)
    for q in rows:
        if best is None or q.loss < best.loss:
            best = q
        elif q.step - best.step >= 2:
            last = q.step
            break
    assert (got.best_epoch, got.best_value, got.last_epoch) == (best.step, best.loss, last)
    want = E.fit(name, df, "y", (0.0, 2.0), settings=grid[best.step - 1]).transform(df)
    assert {q.id: q.y_pred for q in model.transform(df).collect()} == pytest.approx({q.id: q.y_pred for q in want.collect()})
    if name == "ridge":  # the loss is the mean over folds of patients, fitted without them
        from gaitwright.operators.splits import hashed_split

        folds = hashed_split(df.select("subject").distinct(), "subject", 3, 0.0, 1).filter("role = 'test'").select("subject", "round")
        dealt = df.join(folds, "subject")
        errors = [E.fit(name, dealt.filter(F.col("round") != k), "y", settings=grid[1]).transform(dealt.filter(F.col("round") == k)).agg(F.avg(F.abs(F.col("y_pred") - F.col("y")))).first()[0] for k in range(3)]
        assert rows[1].loss == pytest.approx(np.mean(errors), rel=1e-6)
