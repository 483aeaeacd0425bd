"""Lookups, counts, upserts and ordered selections over the engine's tables.

Defined cases: null keys are a group of their own in counts and match nothing in joins and upserts, so that old rows with null keys stay
and new ones are added; of repeated new keys the last by the given order stays, which must be total to be the same in every run; an empty
table gives no rows, but zero-filled counts and shares give theirs; nulls in a condition count as false.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- joins ----------------------------------------------------------------------------------------------------------


def side(frame: DataFrame, few: bool) -> DataFrame:
    """A side of a join: of few rows it is sent to every executor, else the join is by sorting. Left alone, Spark goes by the bytes of files,
    which hold many more rows than their size tells."""
    return F.broadcast(frame) if few else frame.hint("merge")


# --- filters --------------------------------------------------------------------------------------------------------


def all_of(frame: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition that is given."""
    given = [c for c in conditions if c is not None]
    return frame.where(reduce(lambda a, b: a & b, given)) if given else frame


def contains_ci(column: str, part: str) -> Column:
    """Case-insensitive substring; % and _ in `part` match as they do in LIKE."""
    return F.col(column).ilike(f"%{part}%")


def recent(frame: DataFrame, since: str | None, limit: int, at: str = "updated_at", key: str = "id") -> DataFrame:
    rows = frame if since is None else frame.where(F.col(at) >= since)
    return rows.orderBy(F.desc(at), key).limit(limit)


def page(frame: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def first_by(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def resolve_names(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, symbol columns) for each row of query: `Class.member` exactly, other names exactly, a class first; others are left out."""
    own = symbols.columns
    dotted = wanted.where(F.contains("query", F.lit("."))).withColumns({"__class": F.split_part("query", F.lit("."), F.lit(1)), "__member": F.split_part("query", F.lit("."), F.lit(2))})
    by_member = dotted.join(symbols, (F.col("parent_class") == F.col("__class")) & (F.col("name") == F.col("__member"))).select("query", *own)
    by_name = wanted.where(~F.contains("query", F.lit("."))).join(symbols, F.col("name") == F.col("query")).select("query", *own)
    return first_by(by_member.unionByName(by_name), ["query"], [F.col("kind") != "class", "id"])


# --- counts ---------------------------------------------------------------------------------------------------------


def counts(frame: DataFrame, by: str) -> DataFrame:
    return frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def counts_over(frame: DataFrame, by: str, domain: Sequence[str]) -> DataFrame:
    """Counts for every value of a closed domain, 0 where there is none."""
    values = frame.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in domain])).alias(by))
    return values.join(counts(frame, by), by, "left").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def share(frame: DataFrame, condition: Column, empty: float = 0.0) -> DataFrame:
    """One row: n, hits and rate (hits / n, or `empty`)."""
    return frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("hits")).withColumn("rate", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(empty)))


def top_counts(frame: DataFrame, by: str, limit: int = 10) -> DataFrame:
    return counts(frame, by).orderBy(F.desc("n"), by).limit(limit)


# --- mutations ------------------------------------------------------------------------------------------------------


def latest(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by `order`."""
    descending = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return first_by(frame, keys, descending)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str], also_unique: Sequence[str] = ()) -> DataFrame:
    """Old rows, replaced whole by new rows of the same key, or of the same second unique key."""
    last = latest(new, keys, order)
    if also_unique:
        last = latest(last, also_unique, order)
    kept = old.join(last.select(*keys), list(keys), "left_anti")
    if also_unique:
        kept = kept.join(last.select(*also_unique), list(also_unique), "left_anti")
    return kept.unionByName(last.select(*old.columns))


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Old and new rows by key; for both, the new row's columns where they are not null, but the old row's `keep`."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"o.{c}")
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def without(frame: DataFrame, column: str | None = None, value: str | None = None, prefix: bool = False) -> DataFrame:
    """All rows but those of one value (or prefix); none at all without a column."""
    if column is None:
        return frame.limit(0)
    match = F.startswith(F.col(column), F.lit(value)) if prefix else F.col(column) == value
    return frame.where(~F.coalesce(match, F.lit(False)))


def set_status(frame: DataFrame, ids: Sequence[str], status: str, at: Column | None = None) -> DataFrame:
    chosen = F.col("id").isin(*ids)
    out = frame.withColumn("status", F.when(chosen, F.lit(status)).otherwise(F.col("status")))
    return out.withColumn("reviewed_at", F.when(chosen, at).otherwise(F.col("reviewed_at"))) if at is not None else out


def ordered_distinct(lists: str | Column) -> Column:
    """Elements of a list of lists, each once, where it came first."""
    return F.array_distinct(F.flatten(lists))


def display_order(name: str = "name", file_path: str = "file_path", kind: str = "kind") -> list[Column]:
    """Symbols as they are shown: those in the file of their own name first, then by kind."""
    own = F.contains(F.col(file_path), F.concat(F.lit("/"), F.col(name), F.lit(".js")))
    place = F.array_position(F.array(*[F.lit(k) for k in ("class", "function", "enum", "method", "constant")]), F.col(kind))
    return [own.desc(), F.when(place == 0, F.lit(9)).otherwise(place).asc(), F.col(name).asc()]
