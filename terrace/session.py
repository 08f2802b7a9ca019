"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of a batch that goes to a Python worker: whole documents are long, and a worker holds a batch several times. (Spark bounds its bytes, too.)
BATCH_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it lies in a folder that they see too (a cluster gets it with --py-files), and keeps their
    batches small unless the session has set a size of its own."""
    env = spark.sparkContext.environment
    if ROOT not in (known := env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{known}:{ROOT}".strip(":")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names. A local session (as in tests) that names none gets a temporary one; on
    a cluster that would be lost work, so it is an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not (master := spark.sparkContext.master).split("[")[0] == "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        path = tempfile.mkdtemp(prefix="terrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
