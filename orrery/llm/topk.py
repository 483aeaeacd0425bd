"""Exact top-k search by block-at-a-time pruning (block-max pruning).

Vectors become integer components. A shard's rows are ordered so that alike vectors are neighbours and cut into ranges of
rows, the blocks; for each component a block keeps its greatest and least value. For a query the sum over components of
its weight times the greatest (for a negative weight, the least) bounds every score in the block from above. Each query
visits its blocks in descending order of that bound and scores them through the block's forward index, until the bound of
the next falls below its k-th score; at an equal bound a block is visited only if it holds a smaller id.

Queries are dealt in chunks against shards of rows, each pair of the two one task of bounded size; a task gives k rows for a
query at most, and the best k of these are the answer.

Defined cases: vectors that are null or hold a null or non-finite component take no part; nor do rows with a null id, which
could not be named; vectors of unequal length are compared as if the shorter went on with zeros; a query is not compared
with rows of its own id; equal query rows count once; equal candidate rows each count. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens

BLOCK_ROWS = 64
SHARD_ROWS = (8192, 262_144)
QUERY_ROWS = 8192
_WAVE = 8


def integers(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str | Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite if isinstance(vector, str) else vector.isNotNull() & finite


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows padded with zeros; doubles where products are exact in them, else Python's integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def _exact(rows: np.ndarray, queries: np.ndarray) -> type:
    largest = int(max(1, abs(rows).max(initial=0))) * int(max(1, abs(queries).max(initial=0))) * max(1, rows.shape[1])
    return np.float64 if largest < 1 << 53 else object


def _order(rows: np.ndarray) -> np.ndarray:
    """Alike rows next to each other: by the component of greatest size and its sign, then by all components."""
    if not rows.shape[1]:
        return np.arange(len(rows))
    top = np.abs(rows).argmax(axis=1)
    sign = rows[np.arange(len(rows)), top] > 0
    return np.lexsort((*rows.T[::-1], sign, top))


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores (queries x k; float64 or object, -inf where there are fewer), and how many blocks were scored."""
    kind = _exact(rows, queries)
    order = _order(rows)
    ids, rows, queries = ids[order], rows[order].astype(kind), queries.astype(kind)
    begin = np.arange(0, len(ids), block)
    greatest, least = np.maximum.reduceat(rows, begin, axis=0), np.minimum.reduceat(rows, begin, axis=0)
    first_id = np.minimum.reduceat(ids, begin)
    bounds = (np.maximum(queries, 0) @ greatest.T + np.minimum(queries, 0) @ least.T).astype(kind)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    none = np.iinfo(np.int64).max
    low = -np.inf
    best = np.full((len(queries), k), low, kind)
    best_ids = np.full((len(queries), k), none, np.int64)
    scored = 0
    for wave in range(0, len(begin), _WAVE):
        turn = visit[:, wave : wave + _WAVE]
        own = np.take_along_axis(bounds, turn, 1)
        kth, kth_id = best[:, -1:], best_ids[:, -1:]
        wanted = (own > kth) | (own == kth) & (first_id[turn] < kth_id)
        active = np.flatnonzero(wanted.any(axis=1))
        if not len(active):
            if not (own[:, 0] >= kth[:, 0]).any():
                break
            continue
        found = np.full((len(active), turn.shape[1] * block), low, kind)
        found_ids = np.full(found.shape, none, np.int64)
        who, slot = np.nonzero(wanted[active])
        blocks = turn[active][who, slot]
        by = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[by], prepend=-1))
        for pairs in np.split(by, cuts[1:]):
            b = begin[blocks[pairs[0]]]
            part, names = rows[b : b + block], ids[b : b + block]
            scores = queries[active[who[pairs]]] @ part.T
            scores[query_ids[active[who[pairs]]][:, None] == names] = low
            place = slot[pairs][:, None] * block + np.arange(len(names))
            found[who[pairs][:, None], place] = scores
            found_ids[who[pairs][:, None], place] = names
            scored += len(pairs)
        both = np.concatenate([best[active], found], axis=1)
        both_ids = np.concatenate([best_ids[active], found_ids], axis=1)
        if kind is np.float64 and both.shape[1] > 4 * k:
            edge = -np.partition(-both, k - 1, axis=1)[:, k - 1 : k]
            keep = both >= edge
            most = int(keep.sum(axis=1).max())
            if most < both.shape[1] // 2:
                pick = np.argsort(~keep, axis=1, kind="stable")[:, :most]
                both, both_ids = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
        pick = np.lexsort((both_ids, -both), axis=1)[:, :k]
        best[active], best_ids[active] = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
    return best_ids, best, scored


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, shard_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), the key of the candidate and its score, for every row that `is_query` holds for."""
    base = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("__id"), is_query.alias("__asks"), integers(vector, scale).alias("__v"))
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("__asks").alias("q"), F.max(F.size("__v")).alias("d")).first()
    rows = shard_rows or min(SHARD_ROWS[1], max(SHARD_ROWS[0], seen["n"] // 256))
    shards, chunks, width = max(1, -(-seen["n"] // rows)), max(1, -(-seen["q"] // query_rows)), max(1, seen["d"] or 0)
    mixed = F.xxhash64("__id", "__v")
    asked = base.where("__asks").select("__id", "__v").distinct()
    left = base.select("__id", "__v", F.pmod(mixed, F.lit(shards)).cast("int").alias("__shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("__chunk"))
    right = asked.select("__id", "__v", F.pmod(F.xxhash64(F.lit(7), "__id", "__v"), F.lit(chunks)).cast("int").alias("__chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("__shard"))

    def task(own: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "__q", "__c", "score"]
        if not own.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        q = queries.column("__id").to_numpy()
        ids, scores, _ = search_shard(own.column("__id").to_numpy(), _matrix(own.column("__v"), width), q, _matrix(queries.column("__v"), width), k)
        who, slot = np.nonzero(ids != np.iinfo(np.int64).max)
        number = queries.column("__h").to_numpy()
        return pa.table({"query_id": q[who], "__q": number[who], "__c": ids[who, slot], "score": scores[who, slot].astype(np.int64)})

    right = right.withColumn("__h", F.xxhash64("__v"))
    found = left.groupBy("__shard", "__chunk").cogroup(right.groupBy("__shard", "__chunk")).applyInArrow(tokens.released(task), "query_id long, __q long, __c long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "__q").orderBy(F.desc("score"), "__c"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("__c").alias(key), "score")
