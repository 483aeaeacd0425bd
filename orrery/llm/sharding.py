"""Sharding by histogram sort: probe candidate boundaries, refine them to splitters, exchange once. Built-in functions only.

Rows are ordered by a key of two 60-bit numbers: a hash of the text, so that equal texts are neighbours, then a hash of the
id. Each round counts the exact bytes and rows between 4,096 evenly spaced probes of every interval that still holds an
unresolved boundary; only those counts reach the driver. A boundary is settled when the bytes below a probe are within the
tolerance of its target. After that the rows are exchanged once, to buckets of bounded size, and their slots follow from
the counts already known.

A group of equal texts stands together, but no shard can be near equal in size if a group of a third of all rows may not be
split: where a boundary falls inside a group, the group goes on in the next shard, and nowhere else.

Defined cases: a null text has no bytes; null ids sort together; rows equal in id and text have equal keys and are not
told apart, so they stay in one bucket; columns of the input named like an output column are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

_BITS, _STEP = 60, 12
_MASK = (1 << _BITS) - 1
_KEYS = ("__k0", "__k1")
#: Fixed bytes that a row counts besides its text.
ROW_BYTES = 8


@dataclass
class _Open:
    """An interval of keys with boundaries in it: `depth` bits of word `word` are settled, the words before it wholly."""

    prefix: tuple[int, ...]
    low: int
    depth: int
    bytes_below: int
    rows_below: int
    targets: list[int]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a folded literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")))


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumns({"size": size_of(F.col(text)), _KEYS[0]: F.xxhash64(text).bitwiseAND(F.lit(_MASK)), _KEYS[1]: F.xxhash64(key).bitwiseAND(F.lit(_MASK))})


def _probe(keys: DataFrame, opened: list[_Open]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Bytes and rows in each part of each open interval, and the least and greatest next word there."""
    word, depth = len(opened[0].prefix), opened[0].depth
    shift = _BITS - depth - _STEP
    rows = [(i, *o.prefix, o.low >> (_BITS - depth)) for i, o in enumerate(opened)]
    names = ["interval", *(f"p{w}" for w in range(word)), "part"]
    small = table(keys.sparkSession, rows, ", ".join(f"{n} bigint" for n in names))
    on = [F.col(_KEYS[w]) == F.col(f"p{w}") for w in range(word)] + [F.shiftright(_KEYS[word], _BITS - depth) == F.col("part")]
    found = (
        keys.join(F.broadcast(small), on)
        .groupBy("interval", F.shiftright(_KEYS[word], shift).bitwiseAND(F.lit((1 << _STEP) - 1)).alias("probe"))
        .agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.min(_KEYS[word]).alias("lo"), F.max(_KEYS[word]).alias("hi"))
    )
    return {(r["interval"], r["probe"]): (r["w"], r["n"], r["lo"], r["hi"]) for r in found.collect()}


def splitters(keys: DataFrame, total: int, targets: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """For each target (weight below it: tolerance) in order: the splitter's two key words, and the weight and rows below it."""
    found: dict[int, tuple[int, int, int, int]] = {}
    waiting = [_Open((), 0, 0, 0, 0, sorted(targets))]
    while waiting:
        now = [o for o in waiting if (len(o.prefix), o.depth) == (len(waiting[0].prefix), waiting[0].depth)]
        waiting = [o for o in waiting if (len(o.prefix), o.depth) != (len(now[0].prefix), now[0].depth)]
        counts = _probe(keys, now)
        parts: dict[int, list[tuple[int, tuple[int, int, int, int]]]] = {}
        for (i, p), c in sorted(counts.items()):
            parts.setdefault(i, []).append((p, c))
        for i, o in enumerate(now):
            shift = _BITS - o.depth - _STEP
            pad = (0,) * (len(_KEYS) - 1 - len(o.prefix))
            at, below, rows = 0, o.bytes_below, o.rows_below
            mine = parts.get(i, [])
            for target in o.targets:
                while at < len(mine) and below + mine[at][1][0] <= target:
                    below, rows, at = below + mine[at][1][0], rows + mine[at][1][1], at + 1
                if at == len(mine):
                    found[target] = (_MASK + 1, 0, below, rows)
                    continue
                part, (weight, n, lo, hi) = mine[at]
                start = o.low | part << shift
                before, after = (*o.prefix, start, *pad), (*o.prefix, start + (1 << shift), *pad)
                tied = lo == hi
                settled = tied and len(o.prefix) + 1 == len(_KEYS)
                if target - below <= targets[target] or settled and 2 * (target - below) <= weight:
                    found[target] = (*before, below, rows)
                elif below + weight - target <= targets[target] or settled:
                    found[target] = (*((*o.prefix, lo + 1) if settled else after), below + weight, rows + n)
                else:
                    prefix, low, depth = ((*o.prefix, lo), 0, 0) if tied else (o.prefix, start, o.depth + _STEP)
                    same = next((x for x in waiting if (x.prefix, x.low, x.depth) == (prefix, low, depth)), None)
                    if same:
                        same.targets.append(target)
                    else:
                        waiting.append(_Open(prefix, low, depth, below, rows, [target]))
    return [found[t] for t in sorted(targets)]


def assign(docs: DataFrame, shards: int, law: str = "bytes", key: str = "doc_id", text: str = "text", tolerance: float = 0.0005, bucket_rows: int = 250_000, most_buckets: int = 2400) -> DataFrame:
    """``docs`` with `size`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in a shard).

    law: ``bytes`` makes the shards' sizes near equal, within `tolerance` of a shard or one row; ``rows`` their counts.
    A shard is dealt over as many buckets, each sorted by one task, as `bucket_rows` asks for, up to `most_buckets` in all.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be bytes or rows, not {law!r}")
    spark = docs.sparkSession
    keyed = _keyed(docs.drop("shard", "slot", "size", *_KEYS), key, text)
    keys = keyed.select(*_KEYS, (F.col("size") if law == "bytes" else F.lit(1).cast("long")).alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    whole = keys.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total, rows = int(whole["w"] or 0), int(whole["n"])
    each = max(1, min(most_buckets // shards, -(-rows // (shards * bucket_rows))))
    parts = shards * each
    exact = max(0, int(total / shards * tolerance)) if law == "bytes" else 0
    targets: dict[int, int] = {}
    for j in range(1, parts):
        target = total * j // parts
        targets[target] = min(targets.get(target, 1 << 62), exact if j % each == 0 else total // parts // 4)
    settled = dict(zip(sorted(targets), splitters(keys, total, targets), strict=True)) if total else {}
    keys.unpersist()
    cuts = [settled.get(total * j // parts, (0, 0, 0, 0)) for j in range(1, parts)]

    first_rows = [0, *(c[3] for c in cuts)]
    places = table(spark, [(b, b // each, first_rows[b] - first_rows[b - b % each]) for b in range(parts)], "__bucket int, shard int, __from bigint")
    shift = _BITS - _STEP
    inside: dict[int, list[tuple[int, int]]] = {}
    for c in cuts:
        inside.setdefault(min(c[0] >> shift, (1 << _STEP) - 1), []).append((c[0], c[1]))
    base, coarse = 0, []
    for p in range(1 << _STEP):
        own = inside.get(p, [])
        coarse.append((p, base, [{"a": a, "b": b} for a, b in own]))
        base += len(own)
    coarse_table = table(spark, coarse, "__part bigint, __base int, __cuts array<struct<a:bigint,b:bigint>>")

    row = F.struct(F.col(_KEYS[0]).alias("a"), F.col(_KEYS[1]).alias("b"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*_KEYS, F.col(key)))
    return (
        keyed.join(F.broadcast(coarse_table), F.shiftright(_KEYS[0], shift) == F.col("__part"))
        .withColumn("__bucket", (F.col("__base") + F.size(F.filter("__cuts", lambda c: c <= row))).cast("int"))
        .drop("__part", "__base", "__cuts")
        .withColumn("__n", within)
        .join(F.broadcast(places), "__bucket")
        .withColumn("slot", (F.col("__from") + F.col("__n") - 1).cast("long"))
        .drop("__bucket", "__n", "__from", *_KEYS)
    )
