"""Pipeline stages that are saved and loaded with a fitted model: scaling, naming of labels, bounds."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Stage(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that are written with the stage."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._set(**self._input_kwargs)


class Standardiser(_Stage, Estimator):
    """Population mean and SD of each place of an array column; flat places keep scale 1."""

    def _fit(self, df: DataFrame) -> StandardisedModel:
        long = df.select(F.posexplode(self.getInputCol()).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        rows = long.orderBy("p").collect()  # one for each feature
        scale = [float(r.s) if r.s is not None and r.s > 1e-12 else 1.0 for r in rows]
        return StandardisedModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), means=[float(r.m) for r in rows], scales=scale)


class StandardisedModel(_Stage, Model):
    """Adds the scaled vector; an array of another length is an error."""

    means = Param(Params._dummy(), "means", "mean of each place", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scale of each place", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        means, scales = self.getOrDefault("means"), self.getOrDefault("scales")
        fixed = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(means, scales)))
        x = F.col(self.getInputCol())
        wrong = F.raise_error(F.concat(F.lit(f"{len(means)} features are expected, not "), F.size(x).cast("string"))).cast("array<double>")
        z = F.when(F.size(x) == len(means), F.zip_with(x, fixed, lambda v, c: (v - c["m"]) / c["s"])).otherwise(wrong)
        return df.withColumn(self.getOutputCol(), array_to_vector(z))


class NamedLabels(_Stage, Transformer):
    """Puts the label of a number 0, 1, 2... in its place."""

    labels = Param(Params._dummy(), "labels", "labels in order of number", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*map(F.lit, self.getOrDefault("labels")))
        return df.withColumn(self.getOutputCol(), F.element_at(names, F.col(self.getInputCol()).cast("int") + 1))


class Constant(_Stage, Transformer):
    """The same value for every row."""

    value = Param(Params._dummy(), "value", "the value", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.lit(self.getOrDefault("value")))


class Bounded(_Stage, Transformer):
    """Holds a column between two values; nan stays."""

    low = Param(Params._dummy(), "low", "least value", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "greatest value", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        from .contracts import clip

        return df.withColumn(self.getOutputCol(), clip(F.col(self.getInputCol()), self.getOrDefault("low"), self.getOrDefault("high")))
