"""Command line: `python -m orrery TOOL --db FOLDER [--name value ...]` prints a tool's rows as JSON lines.

Tools are the methods of KnowledgeEngine, and: init (create the tables), index (--root FOLDER: scan scripts and shaders), snapshot
(--root FOLDER --version V: keep the symbols of a version), diff (--from V --to V --format text, json or markdown), tree (--symbol NAME
--direction down or up --depth N) and review (--status S --limit N --offset N: candidates with their problems).
"""

from __future__ import annotations

import inspect
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .operators import diff, extract, graph, mining
from .plans import render
from .plans.engine import KnowledgeEngine
from .sources import files
from .sources.store import Store


def _options(words: list[str]) -> dict[str, str]:
    if len(words) % 2 or any(not w.startswith("--") for w in words[::2]):
        sys.exit(__doc__)
    return {k[2:].replace("-", "_"): v for k, v in zip(words[::2], words[1::2], strict=True)}


def _index(spark: SparkSession, store: Store, root: str) -> None:
    built = KnowledgeEngine.index_scripts(files.scripts(spark, root))
    for name, rows in built.items():
        store.write(name, rows)
    from pyspark.sql import functions as F

    linked = extract.link_shaders(extract.shaders(files.shaders(spark, root)), store.read("symbols"))
    store.merge("shader_symbol", linked.withColumn("created_at", F.unix_millis(F.current_timestamp())))


def _snapshot(spark: SparkSession, store: Store, root: str, version: str) -> None:
    from pyspark.sql import functions as F

    found = diff.snapshot(extract.version_symbols(files.scripts(spark, root)), version, F.unix_millis(F.current_timestamp()))
    store.upsert("symbol_snapshot", found, ["snapshot_at"])


def _diff(engine: KnowledgeEngine, given: dict[str, str]) -> str:
    old, new = given["from"], given["to"]
    how = {"text": render.diff_text, "json": render.diff_json, "markdown": render.diff_markdown}[given.get("format", "text")]
    return how(engine.compare_version(old, new, given.get("symbol")).persist(), old, new)


def _tree(engine: KnowledgeEngine, symbol: str, direction: str = "down", depth: str = "2") -> str:
    edges = engine.trace_callgraph(symbol, direction, int(depth)).select("source_name", "target_name", "edge_type").collect()
    down = direction == "down"
    root = engine.resolve(symbol).first()
    name = symbol if root is None else ".".join(x for x in (root["parent_class"], root["name"]) if x)
    return graph.tree([(a, b, kind) if down else (b, a, kind) for a, b, kind in edges], name, int(depth))


def _review(store: Store, status: str = "pending", limit: str = "20", offset: str = "0") -> str:
    page = mining.review(store.read("problem_candidate"), store.read("canonical_problem"), status, int(limit), int(offset))
    return render.review_text(page, status, int(offset))


def main(words: list[str]) -> None:
    if not words:
        sys.exit(__doc__)
    tool, given = words[0], _options(words[1:])
    spark = SparkSession.builder.appName("orrery").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = Store(spark, given.pop("db", os.environ.get("ORRERY_DB") or os.path.expanduser("~/.orrery")))
    if tool == "init":
        store.create()
        return
    if tool == "index":
        _index(spark, store, given["root"])
        return
    if tool == "snapshot":
        _snapshot(spark, store, given["root"], given["version"])
        return
    if tool == "review":
        print(_review(store, **given))
        return
    engine = KnowledgeEngine(spark, {n: store.read(n) for n in schemas.TABLES})
    if tool in ("diff", "tree"):
        print(_diff(engine, given) if tool == "diff" else _tree(engine, **given))
        return
    method = getattr(KnowledgeEngine, tool, None)
    if method is None or tool.startswith("_"):
        sys.exit(f"no tool {tool}\n{__doc__}")
    kinds = {p.name: type(p.default) for p in inspect.signature(method).parameters.values()}
    out = method(engine, **{k: kinds[k](v) if kinds.get(k) in (int, float) else v.lower() == "true" if kinds.get(k) is bool else v for k, v in given.items()})
    for frame in out if isinstance(out, tuple) else (out,):
        if isinstance(frame, DataFrame):
            for line in frame.toJSON().toLocalIterator():
                print(line)
        else:
            print(json.dumps(frame))


if __name__ == "__main__":
    main(sys.argv[1:])
