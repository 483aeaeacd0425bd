"""Packs for many questions or symbols at once: sections are joined and grouped by question, so the number of jobs does not grow with them.

Every step is a join on the question's id; no question has a plan of its own and nothing but figures reaches the driver. Ids must be unique. A
question's pack is one row, so what a pack holds must fit one task, as a budget sees to.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folders
from ..operators import graph, matching, packing, relational

if TYPE_CHECKING:
    from .engine import KnowledgeEngine

#: Issues for each query of a pattern, experiences for a question; sources of callees and issues of a symbol's pack.
ISSUES_A_QUERY, EXPERIENCES, CALLEES, ISSUES_A_SYMBOL = 3, 5, 3, 5
#: Questions for each copy of a pack that they share.
MEMBERS = 1_000


def with_section(packs: DataFrame, frame: DataFrame, name: str, columns: list[str], value: Column | None = None) -> DataFrame:
    """``packs`` with each question's rows as a list of structs in the order of their columns, or of one `value` of them; empty for none."""
    listed = frame.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    if value is not None:
        listed = listed.withColumn(name, F.transform(name, lambda x: x["value"]))
    kind = dict(listed.dtypes)[name]
    return packs.join(listed.hint("merge"), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def shared_diagnoses(engine: KnowledgeEngine, questions: DataFrame, limit: int = 5, budget: int = 6000, hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
    """(packs, members): every different pack once, and each question's.

    Questions that match the same patterns in the same order and find the same experiences have one pack, whatever their scores: which symbols,
    sources, edges, issues, stages, steps and fixes it has and what the budget leaves of them follows from that. Its query_id is its own, and where a
    question's pack has the negative score of a pattern (`s`) it has the pattern's place. members: query_id, `pack`, and the question's own
    matched_patterns and related_experiences, which are not cut. What patterns are is told by 256 bits of a hash.
    """
    asked = questions.select("query_id", "question")
    found = matching.match_patterns(asked, engine.patterns, limit, engine.vector_scores_of(asked) if hybrid else None).withColumn("s", -F.col("score"))
    found = folders.stored(found.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("s", "ordinal")) - 1), "matches")
    nodes = engine.tables["experience_node"].select("id", "title", "type")
    experiences = nodes.limit(0).select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.lit(0.0).alias("score"), "id", "title", "type")
    if not nodes.isEmpty():
        hits = folders.stored(engine.search_many("experience_node", "id", ("title", "summary"), asked, EXPERIENCES), "experiences")
        experiences = relational.side(hits, hits.count() <= graph.BROADCAST_ROWS).join(nodes, "id")
    pattern = ["s", "ordinal", "id", "name", "possibleCauses", "score", "matched"]
    content = F.sha2(F.to_json(F.struct("ordinal", "id", "name", "possibleCauses", "relatedSymbols", "issueQueries", "relatedStages", "investigationSteps", "fixSuggestions")), 256)
    members = with_section(asked.select("query_id"), found.withColumn("content", content), "matched_patterns", [*pattern, "place", "content"])
    members = with_section(members, experiences, "related_experiences", ["score", "id", "title", "type"])
    alike = F.struct(F.transform("matched_patterns", lambda x: F.struct(x["place"], x["content"])), F.transform("related_experiences", lambda x: F.struct(x["id"], x["title"], x["type"])))
    own = F.transform("matched_patterns", lambda x: F.struct(*[x[c].alias(c) for c in pattern]))
    members = folders.stored(members.select("query_id", F.sha2(F.to_json(alike), 256).alias("pack"), own.alias("matched_patterns"), "related_experiences"), "members")

    # from here on a pack is a question, the first of those that have it
    first = folders.stored(members.groupBy("pack").agg(F.min("query_id").alias("query_id")), "first")
    few = first.count() <= graph.BROADCAST_ROWS
    of_packs = lambda rows: rows.join(relational.side(first, few), "query_id").drop("query_id").withColumnRenamed("pack", "query_id")
    found = folders.stored(of_packs(found).withColumns({"s": F.col("place").cast("double"), "score": -F.col("place").cast("double")}), "patterns")
    order = F.struct("s", "ordinal")
    listed = lambda c: found.select("query_id", order.alias("o"), F.posexplode(c).alias("n", "value")).groupBy("query_id", "value").agg(F.min(F.struct("o", "n")).alias("at"))
    symbols = folders.stored(matching.related_symbols(found, engine.tables["symbols"]), "symbols")
    few_symbols = symbols.count() <= graph.BROADCAST_ROWS
    sources = relational.side(symbols.select("query_id", "at", "id", "name"), few_symbols).join(engine.tables["source_code"].select(F.col("symbol_id").alias("id"), "code"), "id")
    edges = relational.side(symbols.select("query_id", F.col("id").alias("source_id")), few_symbols).join(engine.tables["call_edges"], "source_id")
    queries = folders.stored(listed("issueQueries").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1), "queries")
    hits = engine.search_many("issues", "id", ("title", "body"), queries.select(F.col("value").alias("query_id"), F.col("value").alias("question")).distinct(), ISSUES_A_QUERY)
    hits = folders.stored(hits.withColumnRenamed("query_id", "value"), "hits")
    told = relational.side(hits, hits.count() <= graph.BROADCAST_ROWS).join(engine.tables["issues"].select("id", "number", "title", "body"), "id")
    issues = relational.side(queries.select("query_id", "value", "k"), queries.count() <= graph.BROADCAST_ROWS).join(told, "value")
    issues = relational.first_by(issues, ["query_id", "id"], ["k", "score"])
    stages = listed("relatedStages").select("query_id", F.col("value").alias("id")).join(engine.stages, "id")
    packs = of_packs(members.select("query_id", "related_experiences"))
    for frame, name, columns in (
        (found, "matched_patterns", ["s", "ordinal", "id", "name", "possibleCauses"]),
        (symbols, "related_symbols", ["at", "id", "name", "kind", "file_path"]),
        (sources, "related_source", ["at", "id", "name", "code"]),
        (edges, "callgraph", ["source_id", "target_id", "edge_type"]),
        (stages, "render_stages", ["order", "id", "name", "description"]),
        (issues, "related_issues", ["k", "score", "id", "number", "title", "body"]),
    ):
        packs = with_section(packs, frame, name, columns)
    for name, column in (("investigation_steps", "investigationSteps"), ("fix_suggestions", "fixSuggestions")):
        packs = with_section(packs, listed(column), name, ["at", "value"], F.col("value"))
    return packing.diagnostic_pack(folders.stored(packs, "sections"), budget), members


def diagnoses(engine: KnowledgeEngine, questions: DataFrame, limit: int = 5, budget: int = 6000, hybrid: bool = False) -> DataFrame:
    """A pack for each row of query_id and question: patterns that match, and what they lead to, within the budget.

    Packs are made once for all questions that share them; one copy goes to `MEMBERS` questions or so, so that no task gets all of a frequent one.
    """
    packs, members = shared_diagnoses(engine, questions, limit, budget, hybrid)
    copies = folders.stored(members.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("copies")), "copies")
    few = copies.count() <= graph.BROADCAST_ROWS
    own = questions.select("query_id", "question").join(members.hint("merge"), "query_id").join(relational.side(copies, few), "pack").withColumn("copy", F.pmod(F.xxhash64("query_id"), "copies")).drop("copies")
    shared = packs.select(*[F.col(c).alias({"query_id": "pack"}.get(c, f"__{c}")) for c in packs.columns])
    shared = shared.join(relational.side(copies, few), "pack").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    both = own.join(shared.hint("merge"), ["pack", "copy"])
    kept = lambda c: F.slice(c, F.lit(1), F.size(f"__{c}"))
    scored = lambda c: F.transform(f"__{c}", lambda e: e.withField("at.o.s", F.get("matched_patterns", e["at"]["o"]["s"].cast("int"))["s"]))
    new = {"matched_patterns": kept("matched_patterns"), "related_experiences": kept("related_experiences"), "related_symbols": scored("related_symbols"), "related_source": scored("related_source")}
    return both.select("query_id", "question", *[new.get(c, F.col(f"__{c}")).alias(c) for c in packs.columns if c != "query_id"])


def context_packs(engine: KnowledgeEngine, symbols: DataFrame, depth: int = 2, budget: int = 5000) -> DataFrame:
    """A pack for each row of query (a symbol's name) that means a symbol: the symbol, its source and that of the nearest three of its callees that
    have source, its edges, and up to five issues about its class."""
    found = folders.stored(engine.resolve_many(symbols), "resolved").withColumnRenamed("query", "query_id")
    edges = folders.stored(graph.search_many(engine.tables["call_edges"], found.select("id"), depth), "edges")
    few, few_edges = found.count() <= graph.BROADCAST_ROWS, edges.count() <= graph.BROADCAST_ROWS
    code = engine.tables["source_code"].select("symbol_id", F.col("name").alias("n"), "code")
    main = relational.side(found.select("query_id", F.lit(0).alias("k"), F.col("id").alias("symbol_id")), few).join(code, "symbol_id")
    calls = edges.where(F.col("target_id") != F.col("root")).groupBy("root", F.col("target_id").alias("symbol_id")).agg(F.min("depth").alias("k"))
    calls = relational.side(calls, few_edges).join(code, "symbol_id")
    nearest = F.row_number().over(Window.partitionBy("root").orderBy("k", "symbol_id"))
    calls = calls.withColumn("place", nearest).where(F.col("place") <= CALLEES)
    roots = relational.side(found.select("query_id", F.col("id").alias("root")), few)
    rest = roots.join(calls, "root").select("query_id", "k", "symbol_id", "n", "code")
    about = found.select("query_id", F.coalesce("parent_class", "name").alias("value"))
    hits = engine.search_many("issues", "id", ("title", "body"), about.select(F.col("value").alias("query_id"), F.col("value").alias("question")).distinct(), ISSUES_A_SYMBOL)
    hits = folders.stored(hits.withColumnRenamed("query_id", "value"), "hits")
    told = relational.side(hits, hits.count() <= graph.BROADCAST_ROWS).join(engine.tables["issues"].select("id", "number", "title", "body"), "id")
    issues = relational.side(about, few).join(told, "value")
    packs = found.select("query_id", F.struct("id", "name", "kind", "file_path", "start_line", "end_line", "doc_comment", "exports", "imports", "parent_class").alias("symbol"))
    own = roots.join(edges, "root")
    for frame, name, columns in (
        (main.select("query_id", "k", "symbol_id", "n", "code").unionByName(rest), "source", ["k", "symbol_id", "n", "code"]),
        (own, "callgraph", ["source_id", "target_id", "edge_type"]),
        (issues, "issues", ["score", "number", "title", "body"]),
    ):
        packs = with_section(packs, frame, name, columns)
    return packing.context_pack(folders.stored(packs, "sections"), budget)
