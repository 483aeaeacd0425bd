"""Symbol snapshots of two versions: differences, kinds of change, breaking changes, stability, drift of generated patterns.

Defined cases: null paths, comments and hashes are equal to each other and to nothing else; of symbols of one id in a version the last by
file and line is the snapshot's; without an old version all symbols are added, without a new one all are removed; identities that match
nothing leave the rate of stability at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

STATUSES = ("added", "removed", "modified", "unchanged")
CHANGES = ("removed", "signature_changed", "renamed")
#: Columns by which a generated pattern differs from a current one.
COMPARED = ("name", "category", "severity", "aliases", "triggerKeywords", "symptoms", "possibleCauses", "relatedSymbols", "relatedStages")


def snapshot(symbols: DataFrame, version: str, at: Column | None = None) -> DataFrame:
    """Snapshot rows of a version's symbols (with code), by ids that stay the same from version to version."""
    fqn = text.qualified_name("name", "parent_class", "file_path")
    rows = symbols.withColumns({"symbol_id": text.stable_id("kind", fqn), "version": F.lit(version), "source_hash": F.sha1("code"), "snapshot_at": at if at is not None else F.lit(None).cast("long")})
    rows = rows.withColumn("id", text.snapshot_id("version", "symbol_id"))
    order = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("file_path"), F.desc("start_line")))
    rows = rows.withColumn("__n", order).where("__n = 1")
    return rows.select("id", "version", "symbol_id", "name", "kind", "file_path", "start_line", "end_line", "doc_comment", "source_hash", "snapshot_at")


def change_type(before: str = "b", after: str = "a") -> Column:
    """A matched pair's kind of change: location, doc, signature, implementation or none, by the first rule that holds."""
    x = lambda side, c: F.col(f"{side}_{c}")
    moved = ~x(before, "file_path").eqNullSafe(x(after, "file_path"))
    doc = ~x(before, "doc_comment").eqNullSafe(x(after, "doc_comment"))
    code = ~x(before, "source_hash").eqNullSafe(x(after, "source_hash"))
    size = F.abs((x(after, "end_line") - x(after, "start_line")) - (x(before, "end_line") - x(before, "start_line")))
    return F.when(moved, "location").when(doc & code & (size == 0), "doc").when(code & (size > 2), "signature").when(code, "implementation").otherwise("none")


def compare(old: DataFrame, new: DataFrame, name: str | None = None) -> DataFrame:
    """(symbol_id, status, change_type, b_*, a_*) of every symbol of either version; name: only symbols whose name holds it."""
    columns = ["version", "name", "kind", "file_path", "start_line", "end_line", "doc_comment", "source_hash"]
    if name:
        old, new = (f.where(F.contains("name", F.lit(name))) for f in (old, new))
    b = old.select("symbol_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    a = new.select("symbol_id", *[F.col(c).alias(f"a_{c}") for c in columns])
    both = b.withColumn("__b", F.lit(True)).join(a.withColumn("__a", F.lit(True)), "symbol_id", "full_outer")
    kind = F.when(F.col("__b") & F.col("__a"), change_type())
    status = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(kind == "none", "unchanged").otherwise("modified")
    return both.withColumns({"change_type": kind, "status": status}).drop("__a", "__b")


def diff_stats(changes: DataFrame) -> DataFrame:
    from .relational import counts_over

    return counts_over(changes, "status", STATUSES)


def breaking_changes(changes: DataFrame, from_version: str, to_version: str) -> DataFrame:
    """Removals, changed signatures and moves, with what happened and what to do."""
    symbol = F.coalesce("a_name", "b_name")
    kind = F.when(F.col("status") == "removed", "removed").when(F.col("change_type") == "signature", "signature_changed").when(F.col("change_type") == "location", "renamed")
    rows = changes.withColumns({"change_type": kind, "symbol_name": symbol}).where(F.col("change_type").isNotNull())
    v, w = F.lit(from_version), F.lit(to_version)
    told = rows.withColumns({"from_version": v, "to_version": w})
    return told.select(text.breaking_id(v, w, "symbol_id").alias("id"), "from_version", "to_version", "symbol_id", "symbol_name", "change_type", _filled(HAPPENED).alias("description"), _filled(TO_DO).alias("migration_guide"))


#: Our own wording of each kind of breaking change: what happened, what to do, and a longer guide. {name}, {before} and {after} are
#: the symbol and the two versions, {old} and {new} its files.
HAPPENED = {"removed": "{name} is gone", "signature_changed": "{name} takes or returns something else", "renamed": "{name} moved from {old} to {new}"}
TO_DO = {"removed": "Find out what took the place of {name}.", "signature_changed": "Compare calls of {name} with its new declaration.", "renamed": "Import {name} from its new file."}
GUIDE = {
    "removed": "## {name} is gone\n\nIt was there in {before} and is not in {after}.\n\n- Search {after} for what does the same.\n- Replace every use of {name}.\n- Read the release notes of {after}.",
    "signature_changed": "## {name} is declared differently\n\nIts declaration in {after} is not that of {before}.\n\n- Read the new declaration.\n- Go through every call of {name}.\n- Run the tests that cover them.",
    "renamed": "## {name} has another place\n\n{after} keeps it in another file than {before}.\n\n- Change the imports of {name}.\n- Its use should stay as it is.",
}


def _filled(wording: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    marks = {"{name}": "symbol_name", "{before}": "from_version", "{after}": "to_version", "{old}": "b_file_path", "{new}": "a_file_path"}
    for kind, template in wording.items():
        said = F.lit(template)
        for mark, column in marks.items():
            if mark in template:
                said = F.replace(said, F.lit(mark), F.col(column))
        out = F.when(F.col("change_type") == kind, said).otherwise(out)
    return out


def migration_text() -> Column:
    """A longer guide for one breaking change, as Markdown."""
    return F.coalesce(_filled(GUIDE), F.concat(F.lit("## "), "symbol_name", F.lit(" changed in "), "to_version"))


def migration_guide(changes: DataFrame) -> DataFrame:
    """One row: all guides in one text, in the order of the symbols."""
    parts = F.array_sort(F.collect_list(F.struct("symbol_name", "id", migration_text().alias("t"))))
    return changes.agg(F.count(F.lit(1)).alias("changes"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("guide"))


def stability(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: totals, identities found in both, those whose id stayed, and the rate. Needs kind, fqn and symbol_id."""
    key = lambda f: f.select(F.concat_ws(":", text.normal_kind("kind"), "fqn").alias("k"), "symbol_id")
    a, b = key(old), key(new)
    one = a.groupBy("k").agg(F.max("symbol_id").alias("before"))
    pairs = b.join(one, "k").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("symbol_id") == F.col("before")).alias("stable"))
    totals = a.agg(F.count(F.lit(1)).alias("total_old")).crossJoin(b.agg(F.count(F.lit(1)).alias("total_new")))
    return totals.crossJoin(pairs).withColumn("rate", F.when(F.col("matched") > 0, F.col("stable") / F.col("matched")).otherwise(F.lit(1.0)))


def pattern_drift(generated: DataFrame, current: DataFrame) -> DataFrame:
    """(id, status): generated patterns that are added, updated or unchanged beside the current ones."""
    g, c = generated.alias("g"), current.withColumn("__here", F.lit(True)).alias("c")
    kinds = dict(current.dtypes)

    def same(name: str) -> Column:
        x, y = F.col(f"g.{name}"), F.col(f"c.{name}")
        if kinds[name].startswith("array"):
            empty = F.array().cast(kinds[name])
            x, y = F.coalesce(x, empty), F.coalesce(y, empty)
        return x.eqNullSafe(y)

    equal = F.lit(True)
    for name in COMPARED:
        if name in current.columns and name in generated.columns:
            equal = equal & same(name)
    return g.join(c, "id", "left").select("id", F.when(F.col("c.__here").isNull(), "added").when(equal, "unchanged").otherwise("updated").alias("status"))
