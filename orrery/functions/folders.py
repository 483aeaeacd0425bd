"""The shared folder for what a job keeps between its steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, also set as the checkpoint directory.

    Where the session names none: a temporary folder if all of Spark runs in this process, an error on a cluster, whose executors
    would each write to a disk of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def stored(frame: DataFrame, what: str) -> DataFrame:
    """Written below the shared folder and read back: later steps neither compute it again nor carry its plan."""
    path = scratch(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def few_splits(frame: DataFrame) -> DataFrame:
    """``frame`` dealt over all cores where its source has fewer splits than there are cores, as one small file has; else as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
