"""Baselines on pyspark.ml: scaling, penalties, folds, saved models."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M
from .cohort import checkpoint_choice, one_hot
from .splits import hashed_split
from .stages import Bounded, Constant, NamedLabels, Standardiser


def standardised(train: DataFrame, rows: DataFrame, vector: str = "x") -> DataFrame:
    """``rows`` with population-standardised ``features``; flat features keep scale 1. Means and scales come from ``train``."""
    return Standardiser(inputCol=vector, outputCol="features").fit(train).transform(rows)


def constant(train: DataFrame, rows: DataFrame, label: str, kind: str) -> DataFrame:
    """Mean, or majority label with ties to the lowest."""
    if kind == "regression":
        value = train.agg(F.avg(label).alias("y_pred"))
    else:
        value = train.groupBy(label).count().agg(F.max_by(label, F.struct("count", -F.col(label))).alias("y_pred"))
    return rows.crossJoin(F.broadcast(value))


def _logistic(n: int, **kw):
    return C.LogisticRegression(regParam=1 / max(1, n), standardization=False, maxIter=200, **kw)


REGISTRY: dict[str, Callable] = {
    # The library scales labels by their population SD before it applies the penalty.
    "ridge": lambda n, spread=1.0, **kw: R.LinearRegression(regParam=spread / max(1, n), elasticNetParam=0, standardization=False, solver="normal", **kw),
    "logistic": _logistic,
    # 30 levels are the library's limit.
    "forest_regression": lambda n, **kw: R.RandomForestRegressor(numTrees=100, maxDepth=30, seed=42, **kw),
    "forest": lambda n, **kw: C.RandomForestClassifier(numTrees=100, maxDepth=30, seed=42, weightCol="weight", **kw),
    "boosted": lambda n, **kw: R.GBTRegressor(maxIter=200, maxDepth=4, stepSize=0.1, seed=42, checkpointInterval=20, **kw),
    "boosted_classes": lambda n, **kw: C.OneVsRest(classifier=C.GBTClassifier(maxIter=200, maxDepth=4, stepSize=0.1, seed=42, checkpointInterval=20), **kw),
}


def fit(name: str, train: DataFrame, label: str, bounds: tuple[float, float] | None = None, vector: str = "x", settings: Mapping[str, object] | None = None) -> PipelineModel:
    """A model that predicts raw rows: scaling by the training rows, the predictor, names of labels, bounds.
    It is saved and loaded whole. ``settings`` of the predictor go before its own.

    Boosted classes are numbered densely for the fit and named back; a single class is predicted as it is.
    """
    after = [Bounded(inputCol="y_pred", outputCol="y_pred", low=float(bounds[0]), high=float(bounds[1]))] if bounds else []
    if name == "boosted_classes":
        classes = [float(r[0]) for r in train.select(label).distinct().orderBy(label).collect()]  # as many as there are labels
        if len(classes) < 2:
            return PipelineModel([Constant(inputCol=vector, outputCol="y_pred", value=classes[0]), *after])
        train = train.withColumn(label, (F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("double")) - 1).cast("double"))
        after = [NamedLabels(inputCol="y_pred", outputCol="y_pred", labels=classes), *after]
    columns = dict(featuresCol="features", labelCol=label, predictionCol="y_pred")
    scaler = Standardiser(inputCol=vector, outputCol="features").fit(train)
    ready = scaler.transform(train)
    if name == "forest":
        counts = train.groupBy(label).agg((1 / F.count("*")).alias("weight"))
        ready = ready.join(F.broadcast(counts), label)
    n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
    if name == "ridge":
        columns["spread"] = spread or 1.0
    stage = REGISTRY[name](n, **columns)
    own = stage.getClassifier() if name == "boosted_classes" else stage
    for key, value in (settings or {}).items():
        own.set(own.getParam(key), value)
    if name == "boosted_classes":
        stage.setClassifier(own)
    return PipelineModel([scaler, stage.fit(ready), *after])


def fit_predict(name: str, train: DataFrame, test: DataFrame, label: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``test`` with ``y_pred`` of a model of ``train``, see :func:`fit`."""
    return fit(name, train, label, bounds).transform(test).select(*test.columns, "y_pred")


def validated(name: str, df: DataFrame, label: str, subject: str, grid: Sequence[Mapping[str, object]], patience: int, folds: int = 3, seed: int = 0, bounds: tuple[float, float] | None = None) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """A model whose settings are chosen on patients that it has not seen: the model of all rows, the history (model,
    step, settings, loss, spread) and the choice (model, best_epoch, best_value, last_epoch).

    Patients are dealt to ``folds`` inner folds by a hash, and every entry of ``grid`` (settings of the predictor, in
    order of step) is fitted without each of them. The loss is the mean absolute error, or one less the weighted F1
    of classes, over the folds. Of the steps up to the one at which ``patience`` steps brought nothing better
    the best is taken, the first of equals.
    """
    spark = df.sparkSession
    dealt = hashed_split(df.select(subject).distinct(), subject, folds, 0.0, seed).filter("role = 'test'")
    inner = df.join(dealt.select(subject, F.col("round").alias("__gw_fold")), subject)
    regression = name in ("ridge", "forest_regression", "boosted")
    columns = dict(featuresCol="features", labelCol=label, predictionCol="y_pred")
    if name == "forest":
        counts = df.groupBy(label).agg((1 / F.count("*")).alias("weight"))
        inner = inner.join(F.broadcast(counts), label)  # one row a class
    n, spread = df.agg(F.count("*"), F.stddev_pop(label)).first()
    stage = REGISTRY[name](n, **columns, **({"spread": spread or 1.0} if name == "ridge" else {}))
    tried = stage.getClassifier() if name == "boosted_classes" else stage
    judge = RegressionEvaluator(labelCol=label, predictionCol="y_pred", metricName="mae") if regression else MulticlassClassificationEvaluator(labelCol=label, predictionCol="y_pred", metricName="f1")
    if name == "boosted_classes":  # the settings belong to the classifier inside
        maps = [{stage.classifier: tried.copy({tried.getParam(k): v for k, v in g.items()})} for g in grid]
    else:
        maps = [{tried.getParam(k): v for k, v in g.items()} for g in grid]
    found = CrossValidator(estimator=Pipeline(stages=[Standardiser(inputCol="x", outputCol="features"), stage]), estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="__gw_fold").fit(inner)
    losses = [m if regression else 1 - m for m in found.avgMetrics]
    rows = [(name, i + 1, json.dumps(dict(g), sort_keys=True), float(v), float(s)) for i, (g, v, s) in enumerate(zip(grid, losses, found.stdMetrics))]
    history = spark.createDataFrame(rows, "model string, step int, settings string, loss double, spread double")  # one row an entry of the grid
    choice = checkpoint_choice(history, ["model"], "step", "loss", patience)
    best = dict(grid[choice.first().best_epoch - 1])
    return fit(name, df, label, bounds, settings=best), history, choice


def cross_fitted(name: str, df: DataFrame, label: str, fold: str, folds: Sequence[int], bounds: tuple[float, float] | None = None) -> DataFrame:
    """Predictions of every row by a model that has not seen its fold."""
    parts = [fit_predict(name, df.filter(F.col(fold) != k), df.filter(F.col(fold) == k), label, bounds) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def isotonic(train: DataFrame, rows: DataFrame, label: str = "y_true", score: str = "y_pred") -> DataFrame:
    """One fit for the whole frame; ``calibration`` has fits by group."""
    model = R.IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(train)
    return model.transform(rows)


def chain_edges(spark, sizes: Sequence[int], dense: Sequence[tuple[int, int]] = (), paired: Sequence[tuple[int, int]] = (), per: int = 1) -> DataFrame:
    """(src, dst) of both directions: neighbours within each group of nodes, all pairs of dense groups,
    and in paired groups node i of the first with the ``per`` nodes from i * per on of the second."""
    first = [sum(sizes[:i]) for i in range(len(sizes))]
    node = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    parts = [node(n, "i").filter(F.col("i") < n - 1).select((F.col("i") + a).alias("src"), (F.col("i") + a + 1).alias("dst")) for a, n in zip(first, sizes)]
    for p, q in dense:
        parts.append(node(sizes[p], "i").crossJoin(node(sizes[q], "j")).select((F.col("i") + first[p]).alias("src"), (F.col("j") + first[q]).alias("dst")))
    for p, q in paired:
        parts.append(node(sizes[q], "j").filter((F.col("j") / per).cast("int") < sizes[p]).select(((F.col("j") / per).cast("int") + first[p]).alias("src"), (F.col("j") + first[q]).alias("dst")))
    one = parts[0]
    for p in parts[1:]:
        one = one.union(p)
    return one.union(one.select("dst", "src")).distinct()


def run_folds(name: str, df: DataFrame, label: str, fold: str, folds: Sequence[int], kind: str, n_classes: int = 0, bounds: tuple[float, float] | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Predictions of every row by a model of the other folds, and the metrics of each fold.

    Classes get the probability 1 for the label predicted, where a model gives none.
    """
    out = cross_fitted(name, df, label, fold, folds, bounds).withColumnRenamed(label, "y_true")
    if kind == "regression":
        return out, M.regression_metrics(out, [fold], tolerance)
    out = out.withColumns({"y_true": F.col("y_true").cast("int"), "y_pred": F.col("y_pred").cast("int")})
    return out.select("*", *one_hot(F.col("y_pred"), n_classes)), M.class_metrics(M.confusion(out, [fold], n_classes), [fold])


def save_model(model: PipelineModel, path: str, **about: object) -> None:
    """Replace a fitted model's files; what is told about it is a JSON table beside them."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    told = [(k, json.dumps(v)) for k, v in sorted(about.items())]
    spark.createDataFrame(told, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(path: str) -> tuple[PipelineModel, dict[str, object]]:
    """A saved model, ready for raw rows, and what was told about it."""
    rows = SparkSession.active().read.schema("name string, value string").json(f"{path}/about").collect()
    return PipelineModel.load(f"{path}/model"), {r.name: json.loads(r.value) for r in rows}
