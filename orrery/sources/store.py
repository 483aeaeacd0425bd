"""Tables as versioned Parquet folders: a change writes the next version beside the last, and readers take the newest complete one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import relational

PARTITIONED = {"symbol_snapshot": ["version"]}
_KEPT = 2


class Store:
    """The engine's tables below a root that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, path = self._folder(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(v[1:]) for v in found if v[0] == "v" and v[1:].isdigit() and fs.exists(self._folder(f"{self.root}/{name}/{v}/_SUCCESS")[1]))

    def create(self) -> None:
        """Every table, empty, where there is none yet."""
        for name, (schema, _) in schemas.TABLES.items():
            if not self.versions(name):
                self.write(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        schema, _ = schemas.TABLES[name]
        held = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{held[-1]}") if held else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        """The table's next version; versions before the last two go."""
        schema, keys = schemas.TABLES[name]
        held = self.versions(name)
        writer = rows.select(*schema.names).sortWithinPartitions(*keys).write.mode("overwrite")
        writer.partitionBy(*PARTITIONED.get(name, [])).parquet(f"{self.root}/{name}/v{(held[-1] if held else 0) + 1}")
        for old in held[: max(0, len(held) + 1 - _KEPT)]:
            fs, path = self._folder(f"{self.root}/{name}/v{old}")
            fs.delete(path, True)

    def upsert(self, name: str, rows: DataFrame, order: Sequence[Column | str] = ()) -> None:
        """Replace rows of the same key (or second key) whole; of several new rows the last by `order` counts."""
        self.write(name, relational.upsert(self.read(name), rows, schemas.TABLES[name][1], list(order) or schemas.TABLES[name][1], schemas.ALSO_UNIQUE.get(name, ())))

    def merge(self, name: str, rows: DataFrame) -> None:
        """Update columns of rows of the same key, keeping when they were created."""
        _, keys = schemas.TABLES[name]
        self.write(name, relational.merge(self.read(name), relational.latest(rows, keys, keys), keys))

    def clear(self, name: str, column: str | None = None, value: str | None = None) -> None:
        self.write(name, relational.without(self.read(name), column, value))

    def set_status(self, name: str, ids: Sequence[str], status: str) -> None:
        self.write(name, relational.set_status(self.read(name), ids, status, F.unix_millis(F.current_timestamp())))

    def cursor(self, source: str) -> str | None:
        row = self.read("meta").where(F.col("key") == f"sync_cursor:{source}").first()
        return row["value"] if row else None

    def set_cursor(self, source: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(f"sync_cursor:{source}", value)], schemas.META))
