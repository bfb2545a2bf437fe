"""Windowed counts over an event stream. An extension: batch sources have no streams of their own.

Each function works on a streaming frame and on a batch frame alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, clock: str = "ts", late: str = "1 hour", per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, with a watermark on the clock."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn(clock, F.col(clock).cast("timestamp")).withWatermark(clock, late)


def tumbling(df: DataFrame, clock: str, length: str, key: str, value: str) -> DataFrame:
    return _summed(df, F.window(clock, length), key, value)


def sliding(df: DataFrame, clock: str, length: str, step: str, key: str, value: str) -> DataFrame:
    return _summed(df, F.window(clock, length, step), key, value)


def sessions(df: DataFrame, clock: str, gap: str, key: str, value: str) -> DataFrame:
    return _summed(df, F.session_window(clock, gap), key, value)


def _summed(df: DataFrame, window, key: str, value: str) -> DataFrame:
    sums = df.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
