"""Session helpers of the corpus operators: shared folders, cut lineage, tables by path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where that is unset a temporary one, in local runs only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder now; what follows reads it from there, also after a lost executor."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Bytes of a batch that is handed to a Python worker, so that long texts don't make it large; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless they are bounded closer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task of a small intermediate table gets at least.
ROWS_A_TASK = 100_000


def narrow(frame: DataFrame, rows: int) -> DataFrame:
    """The frame in no more partitions than so many rows need, as it is if they need as many as a shuffle has."""
    wide = rows // ROWS_A_TASK + 1
    return frame.coalesce(wide) if wide < partitions(frame.sparkSession) else frame


def cut_counted(frame: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """cut, in as few partitions as the rows need, and their number; most: a bound known beforehand, for the writing tasks."""
    kept = cut(frame if most is None else narrow(frame, most))
    rows = kept.count()
    return narrow(kept, rows), rows


def unsized(frame: DataFrame) -> DataFrame:
    """A frame that is cut, without Spark's estimate of its size, which checkpoint() carries on: that of a join is the product of its sides', so a loop that joins a table with what was made of it
    has several times the digits each round, until one number fills the driver. For what rounds hand on; its rows are converted once each time they are read."""
    spark = frame.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(frame._jdf.toJavaRDD(), frame._jdf.schema()), spark)


#: Bytes up to which the small side of a join is sent to every executor.
BROADCAST_BYTES = 8 << 20


def small_side(frame: DataFrame, size: int) -> DataFrame:
    """The frame, broadcast if its size in bytes, as counted, is small; else the join is left to shuffles."""
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame
