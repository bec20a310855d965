"""What executors share with the driver: reliable checkpoints, and this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Python workers that share the driver's file system find this package where the driver did; elsewhere it is installed."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a local folder stands in if all tasks run in this machine's one process, else it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tomelake-')}")
        folder = context.getCheckpointDir()
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
