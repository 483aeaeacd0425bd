"""Scratch tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Every table here is written through Spark, so that executors and the driver see the same files and a lost executor
costs no more than a re-read. Only where the setting is absent and Spark runs in this process is a temporary folder used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folders

#: Spark's setting to remove the shuffles of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS_PER_BATCH = 2000
_BYTES_PER_BATCH = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; an error on a cluster whose session names none."""
    return folders.shared(spark)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system; a path that is gone, or a stopped session, is no error."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def stored(frame: DataFrame, what: str) -> DataFrame:
    """Write ``frame`` as a scratch table and read it back: lineage is cut, later passes don't recompute it, and its shuffles go at once."""
    return stored_at(frame, what)[0]


def stored_at(frame: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The same, with the table's path for whoever removes it before the end."""
    spark, path = frame.sparkSession, new_path(frame.sparkSession, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path), path


#: A key of more rows than this, and than this share of all rows, is joined by a broadcast: at most so many keys.
OFTEN, MOST_OFTEN = 64, 2000


def join_hot(rows: DataFrame, table: DataFrame, on: str, copies: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which has each value of `on` once and in `copies` how many rows have it.

    A value of very many rows would put them all into one task of a join. There can be only a few such values, so these go to the rows
    instead; null finds nothing.
    """
    often = max(OFTEN, (table.agg(F.sum(copies)).first()[0] or 0) // MOST_OFTEN)
    hot = F.broadcast(table.where(F.col(copies) > often))
    others = rows.join(hot.select(on), on, "left_anti").join(table.where(F.col(copies) <= often), on, how)
    return rows.join(hot, on).unionByName(others)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_orrery_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="orrery-package-")) / "orrery.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
        context._orrery_shipped = True


def sample(frame: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """About `rows` of the rows, and never more: those whose hash of `by` falls below a share that their number sets, least hashes first."""
    n = frame.count()
    if n <= rows:
        return frame
    place = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    return frame.where(place < int((1 << 30) * 0.97 * rows / n)).orderBy(place, *by).limit(rows)


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small, so that very long texts don't add up in memory."""
    ship(spark)
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", _ROWS_PER_BATCH),
        ("spark.sql.execution.arrow.maxBytesPerBatch", _BYTES_PER_BATCH),
    ):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
