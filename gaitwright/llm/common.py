"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (tests) gets
    a temporary folder, made once and set as the checkpoint folder; on a cluster it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gaitwright-"))
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaitwright/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/gaitwright/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of texts that travel to a Python worker at once, so that a batch of whole texts stays small.
TEXT_ROWS = 512
Batches = Iterator[pa.RecordBatch]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to ``TEXT_ROWS``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def release() -> None:
    """Give memory that a finished task no longer needs back to the system: workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, with :func:`release` at the end of each task."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """All columns of ``df`` plus ``outputs``; an input column of an output's name is replaced."""
    names = {n.lower() for n in outputs}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(c.alias(n) for n, c in outputs.items()))


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__gw_")))
