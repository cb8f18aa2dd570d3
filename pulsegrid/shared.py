"""Tables that jobs hand on through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, in local runs only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder now; what follows reads it from there, also after a lost executor."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
