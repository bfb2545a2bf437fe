"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of ``spark``, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/gaitwright", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _SENT.add(app)


#: Rows of an Arrow batch where a row is a text, a series or a trial.
WIDE_ROWS = 256


def small_batches(spark: SparkSession, rows: int = WIDE_ROWS) -> None:
    """Lower the session's rows in an Arrow batch to ``rows``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names: its lineage ends there.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gaitwright-"))
    return df.checkpoint()
