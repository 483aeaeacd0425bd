"""Incremental ingest: a stream of changed rows is upserted batch by batch, and counted by windows of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def changes(spark: SparkSession, path: str, schema: T.StructType, format: str = "json", files_per_batch: int = 100) -> DataFrame:
    """A stream of rows from files that appear below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def upserts(stream: DataFrame, store: Store, table: str, order: Sequence[str], checkpoint: str, at: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Upsert everything that is there into a table, then stop. A batch that is repeated after a failure changes nothing.

    at: the event time (a timestamp), by which repeats of a row within `late` are dropped as they arrive.
    """
    from .. import schemas

    keys = schemas.TABLES[table][1]
    rows = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, *order]) if at else stream
    return rows.writeStream.foreachBatch(lambda batch, _: store.upsert(table, batch, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by window and value, complete once the watermark has passed the window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
