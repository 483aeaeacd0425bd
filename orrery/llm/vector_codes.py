"""Compression of vectors to one byte a part: integer product codes with a codebook for each part position.

Components become integers, floor(scale * x). Vectors are cut into equal parts; each part position has a codebook, which starts as that part of
the rows of smallest keys. In each round the driver builds a kd-tree over each codebook and broadcasts it; executors find each part's nearest
entry and give back, for each task, integer sums and counts by entry; these are added up by Spark, and the entries become their parts' mean,
rounded down. What is broadcast or reaches the driver has a row for each entry, however many vectors there are.

The trees are searched for many points at once. A node is entered with those points whose distance to the node's box is below their best one, or
equal to it while the node holds an entry of lower index; so of entries at equal distance the lowest index is found. All arithmetic is exact.

Defined cases: rows whose vector is null or holds a null or non-finite component are left out; rows of a null key have codes, and come last when
the first entries are chosen; of equal keys the lesser vector comes first; repeated rows each count. Vectors shorter than the longest, or than a
multiple of the number of parts, go on with zeros. With fewer rows than entries there are fewer entries. An empty table gives an empty result.
Components must be below 2^28 in size, and squared distances below 2^62, which is checked. Other columns are not passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .topk import usable

#: Rows that are searched at a time, entries of a leaf, and the bound of components.
_ROWS, _LEAF, _MOST = 1 << 14, 16, 1 << 28


@dataclass
class KdTree:
    """A tree over the entries of one codebook. Of each node: its box, its lowest entry, and its entries or its two nodes and their cut."""

    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    inside: list[tuple[np.ndarray, np.ndarray] | tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, entries: np.ndarray, leaf: int = _LEAF) -> KdTree:
        tree = cls()
        tree._add(entries, np.arange(len(entries)), leaf)
        return tree

    def _add(self, entries: np.ndarray, own: np.ndarray, leaf: int) -> int:
        rows, node = entries[own], len(self.first)
        self.low.append(rows.min(axis=0))
        self.high.append(rows.max(axis=0))
        self.first.append(int(own[0]))
        spread = self.high[node] - self.low[node]
        self.inside.append((own, rows))
        if len(own) > leaf and spread.any():
            axis = int(spread.argmax())
            cut = int(np.sort(rows[:, axis])[len(own) // 2])
            cut = cut if (rows[:, axis] < cut).any() else cut + 1
            below = rows[:, axis] < cut
            self.inside[node] = (axis, cut, self._add(entries, own[below], leaf), self._add(entries, own[~below], leaf))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point the nearest entry, of equally near ones that of lowest index, and the squared distance."""
        largest = int(max(np.abs(points).max(initial=0), max(np.abs(b).max(initial=0) for b in (self.low[0], self.high[0]))))
        most = 4 * points.shape[1] * largest**2
        if most >= 1 << 62:
            raise ValueError("squared distances must fit 62 bits")
        kind = np.float64 if most < 1 << 53 else np.int64
        points = points.astype(kind)
        entry, best = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), 1 << 62, kind)

        def visit(node: int, who: np.ndarray) -> None:
            at = points[who]
            gap = np.maximum(np.maximum(self.low[node] - at, at - self.high[node]), 0)
            bound = (gap * gap).sum(axis=1)
            may = (bound < best[who]) | (bound == best[who]) & (self.first[node] < entry[who])
            who, at = who[may], at[may]
            if not len(who):
                return
            if len(self.inside[node]) == 4:
                axis, cut, below, above = self.inside[node]
                here = at[:, axis] < cut
                for side, own in ((below, here), (above, ~here), (above, here), (below, ~here)):
                    if own.any():
                        visit(side, who[own])
                return
            own, rows = self.inside[node]
            rows = rows.astype(kind)
            distance = (at * at).sum(axis=1)[:, None] - 2 * (at @ rows.T) + (rows * rows).sum(axis=1)
            slot = distance.argmin(axis=1)
            found, name = distance[np.arange(len(who)), slot], own[slot]
            better = (found < best[who]) | (found == best[who]) & (name < entry[who])
            best[who[better]], entry[who[better]] = found[better], name[better]

        if len(points):
            visit(0, np.arange(len(points)))
        return entry, best.astype(np.int64)


@dataclass
class Codebooks:
    """Of each part position its entries, as rows of integers."""

    books: list[np.ndarray]
    scale: int

    @property
    def digest(self) -> str:
        """Of all entries' decimal components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def components(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column's components, each row continued with zeros to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(column.offsets.to_numpy())
    whole = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(whole) and np.abs(whole).max() >= _MOST:
        raise ValueError(f"components must be below {_MOST} in size after scaling")
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < counts[:, None]] = whole.astype(np.int64)
    return out


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some thousand rows each."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= _ROWS:
            yield pa.Table.from_batches(waiting)
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting)


def _shape(vectors: DataFrame, vector: str, parts: int) -> int:
    longest = vectors.agg(F.max(F.size(vector)).alias("d")).first()["d"] or 0
    return -(-longest // parts) * parts


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of `parts` positions after so many rounds; none has more than `entries` entries (256 at most, as codes are bytes)."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has from 1 to 256 entries")
    spark = vectors.sparkSession
    scratch.bound_batches(spark)
    kept = vectors.where(usable(vector)).select(F.col(key).alias("__key"), F.col(vector).alias("__v"))
    width = _shape(kept, "__v", parts)
    first = kept.orderBy(F.asc_nulls_last("__key"), F.transform("__v", lambda x: F.floor(x.cast("double") * scale).cast("long"))).limit(entries).select("__v").toArrow()
    rows = components(first.column("__v"), width, scale)
    step = width // parts
    books = Codebooks([rows[:, p * step : (p + 1) * step] for p in range(parts)], scale)
    if not len(rows):
        return books
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree.of(book) for book in books.books])
        size = len(rows)

        def sums(batches: Iterable[pa.RecordBatch], trees=trees, size=size) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros((parts, size, step + 1), np.int64)
            for table in _gathered(batches):
                whole = components(table.column("__v"), width, scale)
                for p, tree in enumerate(trees.value):
                    own = whole[:, p * step : (p + 1) * step]
                    entry, _ = tree.nearest(own)
                    order = np.argsort(entry, kind="stable")
                    begin = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    used = entry[order][begin]
                    total[p, used, 0] += np.diff(np.append(begin, len(entry)))
                    if step:
                        total[p, used, 1:] += np.add.reduceat(own[order], begin, axis=0)
            part, entry = np.nonzero(total[:, :, 0])
            found = total[part, entry]
            lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * step, found[:, 1:].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(found[:, 0]), lists], names=["part", "entry", "n", "sums"])

        added = kept.select("__v").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(step))).alias("sums"))
        for row in added.collect():
            books.books[row["part"]][row["entry"]] = [x // row["n"] for x in row["sums"]]
        trees.unpersist()
    return books


def encode(vectors: DataFrame, books: Codebooks, *passed: str | Column, vector: str = "embedding") -> DataFrame:
    """The columns `passed` with `code` (two hex digits for each part) and `error` (squared distances to the entries, over all parts)."""
    spark = vectors.sparkSession
    scratch.bound_batches(spark)
    kept = vectors.where(usable(vector))
    parts, scale = len(books.books), books.scale
    own = kept.select(*passed)
    source = kept.select(*passed, F.col(vector).alias("__v"))
    schema = T.StructType([*own.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not len(books.books[0]):
        return spark.createDataFrame([], schema)
    width = max(_shape(kept, vector, parts), books.books[0].shape[1] * parts)
    step = width // parts
    wider = [np.pad(b, ((0, 0), (0, step - b.shape[1]))) for b in books.books]
    trees = spark.sparkContext.broadcast([KdTree.of(book) for book in wider])
    digits = np.array([f"{i:02x}" for i in range(256)])

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            whole = components(table.column("__v"), width, scale)
            code, error = np.full(len(whole), "", "U1"), np.zeros(len(whole), np.int64)
            for p, tree in enumerate(trees.value):
                entry, distance = tree.nearest(whole[:, p * step : (p + 1) * step])
                code, error = np.char.add(code, digits[entry]), error + distance
            yield from pa.table([*table.drop_columns(["__v"]).columns, pa.array(code.tolist(), pa.string()), pa.array(error)], names=schema.names).to_batches()

    return source.mapInArrow(codes, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", to: str = "decoded") -> DataFrame:
    """`codes` with the vector that each code stands for; a null code stands for none."""
    shape = books.books[0].shape[1] if len(books.books[0]) else 0
    every = F.array(*(F.array(*(F.array(*(F.lit(float(x) / books.scale) for x in row)) for row in book.tolist())) for book in books.books)) if shape else None
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    vector = F.concat(*(every[p][entry(p)] for p in range(len(books.books)))) if every is not None else F.array().cast("array<double>")
    return codes.withColumn(to, F.when(F.col(code).isNotNull(), vector))


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """key, code, error, label_error (the errors of equal labels summed, null labels together) and codebooks_sha256 for each row that has a vector."""
    books = train(vectors, key, vector, parts, entries, rounds, scale)
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")).alias("__label")
    rows = scratch.stored(encode(vectors, books, F.col(key), name, vector=vector), "codes")
    errors = rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__rows"))
    told = scratch.join_hot(rows, scratch.stored(errors, "label-errors"), "__label", "__rows")
    return told.select(key, "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
