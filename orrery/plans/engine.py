"""The engine's tools, one method each; every one returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folders
from ..operators import diff, evidence, extract, fts, graph, matching, packing, ranked, relational, vectors
from ..sources import knowledge
from . import batch

Encoder = Callable[[list[str]], list[list[float]]]


class KnowledgeEngine:
    """Answers from tables (see `schemas.TABLES`; missing ones count as empty) and knowledge files."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], patterns: DataFrame | None = None, stages: DataFrame | None = None, skills: DataFrame | None = None, encoder: Encoder | None = None, index_root: str | None = None) -> None:
        """index_root: a folder that Spark can write to, for full-text indexes that are stored once and read by every query."""
        from .. import schemas

        self.spark = spark
        self.tables = {n: tables[n] if n in tables else spark.createDataFrame([], s) for n, (s, _) in schemas.TABLES.items()}
        self.patterns = patterns if patterns is not None else knowledge.patterns(spark)
        self.stages = stages if stages is not None else knowledge.stages(spark)
        self.skills = skills if skills is not None else knowledge.skills(spark)
        self.encoder = encoder or (lambda texts: [vectors.hashed_embedding(t) for t in texts])
        self._indexes: dict[str, fts.Index] = {}
        self._index_root = index_root

    # --- helpers ---

    def _index(self, name: str, key: str, *columns: str) -> fts.Index:
        if name not in self._indexes:
            fresh = fts.Index.build(self.tables[name], key, columns)
            if self._index_root is not None:
                path = f"{self._index_root.rstrip('/')}/{name}"
                fresh.write(path)
                fresh = fts.Index.read(self.spark, path, dict(self.tables[name].dtypes)[key])
            self._indexes[name] = fresh
        return self._indexes[name]

    def _search(self, name: str, key: str, columns: tuple[str, ...], query: str, limit: int, condition: Column | None = None) -> DataFrame:
        return fts.search(self._index(name, key, *columns), self.tables[name], key, query, limit, condition)

    def search_many(self, name: str, key: str, columns: tuple[str, ...], questions: DataFrame, limit: int) -> DataFrame:
        """(query_id, rank, key, score): the best rows of a table for each row of query_id and question; one plan, however many there are.

        With an `index_root` the table's kept index is asked (and made from the table if there is none yet), else fresh lists of terms.
        """
        if self._index_root is None:
            return fts.search_many(self._index(name, key, *columns), questions, limit, name=key)
        index = ranked.Index(self.spark, f"{self._index_root.rstrip('/')}/{name}-kept", key, columns)
        if not index.state().version:
            index.upsert(self.tables[name])
        return index.search(questions, limit)

    def resolve_many(self, symbols: DataFrame) -> DataFrame:
        """(query, symbol columns) for each row of query that means a symbol; each query once. See `resolve`."""
        wanted = folders.stored(symbols.select("query").distinct(), "wanted")
        few = wanted.count() <= graph.BROADCAST_ROWS
        exact = folders.stored(relational.resolve_names(relational.side(wanted, few), self.tables["symbols"]), "exact")
        # only names that mean no symbol exactly are searched for
        left = wanted.where(~F.contains("query", F.lit("."))).join(relational.side(exact.select("query"), few), "query", "left_anti")
        plain = folders.stored(left.select(F.col("query").alias("query_id"), F.col("query").alias("question")), "plain")
        if plain.isEmpty():
            return exact
        best = folders.stored(self.search_many("symbols", "id", ("name", "doc_comment"), plain, 1).select(F.col("query_id").alias("query"), "id"), "best")
        best = relational.side(best, best.count() <= graph.BROADCAST_ROWS)  # few: the symbols' texts are not exchanged
        return exact.unionByName(best.join(self.tables["symbols"], "id").select(*exact.columns))

    def _asked(self, question: str) -> DataFrame:
        return self.spark.range(1).select(F.lit("q").alias("query_id"), F.lit(question).alias("question"))

    def resolve(self, symbol: str) -> DataFrame:
        """(query, symbol columns) of the symbol that a name means: `Class.member` exactly; else exactly; else the search's best."""
        return self.resolve_many(self.spark.range(1).select(F.lit(symbol).alias("query")))

    # --- retrieval ---

    def search_symbol(self, query: str, limit: int = 10) -> DataFrame:
        return self._search("symbols", "id", ("name", "doc_comment"), query, limit)

    def get_source(self, symbol_id: str) -> DataFrame:
        return self.tables["source_code"].where(F.col("symbol_id") == symbol_id).limit(1)

    def search_source(self, query: str, limit: int = 20) -> DataFrame:
        found = self._search("source_code", "symbol_id", ("code",), query, limit)
        return found.withColumn("snippet", fts.snippet("code", query)).drop("code")

    def search_issue(self, query: str, limit: int = 10, state: str | None = None) -> DataFrame:
        return self._search("issues", "id", ("title", "body"), query, limit, None if state is None else F.col("state") == state).drop("body")

    def search_pull_request(self, query: str, limit: int = 10) -> DataFrame:
        return self._search("pull_requests", "id", ("title", "body"), query, limit)

    def search_forum(self, query: str, limit: int = 10, least_quality: float = 0.0) -> DataFrame:
        return self._search("forum_posts", "id", ("title", "body"), query, limit, F.col("quality_score") >= least_quality if least_quality > 0 else None)

    def search_experience(self, query: str, limit: int = 10, type: str | None = None, symbol: str | None = None, least_quality: float | None = None) -> DataFrame:
        conditions = [None if type is None else F.col("type") == type, None if symbol is None else F.array_contains("related_symbols", symbol), None if not least_quality else F.col("quality_score") >= least_quality]
        given = [c for c in conditions if c is not None]
        both = given[0] if given else None
        for c in given[1:]:
            both = both & c
        return self._search("experience_node", "id", ("title", "summary"), query, limit, both)

    def semantic_search_experience(self, query: str, limit: int = 10, least: float | None = None, type: str | None = None) -> DataFrame:
        condition = F.col("type") == "experience"
        return vectors.similar(self.tables["vectors"], self.encoder([query])[0], limit, least, condition if type is None else condition & (F.col("node_type") == type))

    def search_knowledge_base(self, query: str, limit: int = 10, least: float | None = None) -> DataFrame:
        return vectors.similar(self.tables["vectors"], self.encoder([query])[0], limit, least)

    # --- graphs ---

    def trace_callgraph(self, symbol: str, direction: str = "down", depth: int = 2) -> DataFrame:
        roots = self.resolve(symbol).select("id")
        return (graph.downstream if direction == "down" else graph.upstream)(self.tables["call_edges"], roots, depth)

    def get_experience_chain(self, node_id: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        return graph.chain(self.tables["experience_edge"], self.tables["experience_node"], node_id, depth)

    def query_render_stage(self, stage: str | None = None, problem: str | None = None) -> DataFrame:
        out = self.stages if stage is None else self.stages.where(F.col("id") == stage)
        if problem is not None:
            ids = self.patterns.where(F.col("id") == problem).select(F.explode("relatedStages").alias("id"))
            out = out.join(ids, "id", "left_semi")
        return out.orderBy("order")

    # --- diagnosis ---

    def vector_scores(self, question: str) -> DataFrame:
        """(query_id, id, vector_score) of all patterns by the question's embedding."""
        points = self.tables["vectors"].where("type = 'pattern'")
        found = vectors.similar(points, self.encoder([question])[0], None)
        return found.select(F.lit("q").alias("query_id"), F.regexp_replace("node_id", "^pattern:", "").alias("id"), F.col("score").alias("vector_score"))

    def vector_scores_of(self, questions: DataFrame) -> DataFrame:
        """The same for each row of query_id and question. The executors call the encoder, so they must be able to import it."""
        encode = F.pandas_udf(_batched(self.encoder), "array<double>")
        asked = questions.select("query_id", encode(F.coalesce("question", F.lit(""))).alias("vector"))
        points = self.tables["vectors"].where("type = 'pattern'").select(F.regexp_replace("node_id", "^pattern:", "").alias("id"), "vector")
        return vectors.nearest(asked, points, max(1, points.count()), None).select("query_id", "id", F.col("score").alias("vector_score"))

    def match(self, question: str, limit: int | None = None, hybrid: bool = False) -> DataFrame:
        return matching.match_patterns(self._asked(question), self.patterns, limit, self.vector_scores(question) if hybrid else None)

    def diagnose_many(self, questions: DataFrame, limit: int = 5, budget: int = 6000, hybrid: bool = False) -> DataFrame:
        """For each row of query_id and question: patterns that match, and the symbols, source, edges, issues, stages, steps and fixes they
        lead to, within the budget."""
        return batch.diagnoses(self, questions, limit, budget, hybrid)

    def diagnose_shared(self, questions: DataFrame, limit: int = 5, budget: int = 6000, hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
        """The same packs, each different one once, and which of them each question has: see `batch.shared_diagnoses`."""
        return batch.shared_diagnoses(self, questions, limit, budget, hybrid)

    def diagnose_problem(self, problem: str, limit: int = 5, budget: int = 6000, hybrid: bool = False) -> DataFrame:
        """One row: see `diagnose_many`."""
        return self.diagnose_many(self._asked(problem), limit, budget, hybrid).drop("query_id")

    def diagnose_root_cause(self, question: str, least_confidence: float = 0.3) -> DataFrame:
        return evidence.diagnose(self._asked(question), self.patterns, self.tables["shader_symbol"], least_confidence)

    # --- skills and packs ---

    def entities(self, question: str) -> DataFrame:
        return matching.entities(self._asked(question), self.stages, self.patterns, self.tables["symbols"])

    def dispatch_skill(self, question: str) -> DataFrame:
        return matching.dispatch(self._asked(question), self.skills, self.entities(question))

    def build_context_packs(self, symbols: DataFrame, depth: int = 2, budget: int = 5000) -> DataFrame:
        """For each row of query that means a symbol: the symbol, its source and that of the nearest three callees that have source, its edges,
        and up to five issues about its class."""
        return batch.context_packs(self, symbols, depth, budget)

    def build_context_pack(self, symbol: str, depth: int = 2, budget: int = 5000) -> DataFrame:
        """One row: see `build_context_packs`."""
        return self.build_context_packs(self.spark.range(1).select(F.lit(symbol).alias("query")), depth, budget).drop("query_id")

    def build_skill_pack(self, question: str, budget: int = 6000) -> DataFrame:
        """One row: what the question's skill asks for, within the budget."""
        chosen = self.dispatch_skill(question).first()
        config = self.skills.where(F.col("id") == chosen["skill"]).first()["retrieval"]
        entity = [r["value"] for r in self.entities(question).where("type = 'symbol'").orderBy("position").collect()]
        symbol = self.resolve(entity[0]).limit(1) if entity else self.tables["symbols"].limit(0)
        pack = self.spark.range(1).select(F.lit(question).alias("query"), F.struct(F.lit(chosen["skill"]).alias("skill"), F.lit(chosen["confidence"]).alias("confidence")).alias("dispatch"))
        one = _packed(symbol, "s", ["id", "name", "kind", "file_path", "doc_comment", "parent_class"])
        pack = pack.crossJoin(one).withColumn("symbol", F.get("s", F.lit(0))).drop("s")
        source = symbol.select(F.col("id").alias("symbol_id")).join(self.tables["source_code"].select("symbol_id", "name", "code"), "symbol_id")
        edges = graph.downstream(self.tables["call_edges"], symbol.select("id"), config["callgraphDepth"]) if entity else self.tables["call_edges"].limit(0)
        words = entity[0].split(".")[0] if entity else question
        issues = self._search("issues", "id", ("title", "body"), words, config["issueLimit"]) if config["issueLimit"] else self.tables["issues"].limit(0)
        forum = self.search_forum(words, config["forumLimit"]) if config["includeForum"] and config["forumLimit"] else self.tables["forum_posts"].limit(0)
        experience = self.search_experience(words, 5) if config["includeExperience"] else self.tables["experience_node"].limit(0)
        found = self.match(question, 3) if config["includeDiagnosis"] else self.match(question, 3).limit(0)
        stages = self.stages.join(found.select(F.explode("relatedStages").alias("id")), "id", "left_semi") if config["includeRenderStages"] else self.stages.limit(0)
        for frame, name, columns in (
            (source, "source", ["symbol_id", "name", "code"]),
            (edges, "callgraph", ["source_id", "target_id", "edge_type"]),
            (issues.select("id", "number", "title", "body"), "issues", ["id", "number", "title", "body"]),
            (forum.select("id", "title", "body"), "forum", ["id", "title", "body"]),
            (experience.select("id", "title", "summary"), "experience", ["id", "title", "summary"]),
            (stages, "render_stages", ["order", "id", "name", "description"]),
            (found, "matched_patterns", ["id", "name", "score"]),
        ):
            pack = pack.crossJoin(_packed(frame, name, columns))
        for name, column in (("investigation_steps", "investigationSteps"), ("diagnosis_fixes", "fixSuggestions"), ("fix_suggestions", "fixSuggestions")):
            pack = pack.crossJoin(found.agg(F.array_distinct(F.flatten(F.collect_list(column))).alias(name)))
        return packing.skill_pack(pack, budget)

    # --- versions and shaders ---

    def compare_version(self, from_version: str, to_version: str, symbol: str | None = None) -> DataFrame:
        at = lambda v: self.tables["symbol_snapshot"].where(F.col("version") == v)
        return diff.compare(at(from_version), at(to_version), symbol)

    def detect_breaking_changes(self, from_version: str, to_version: str) -> DataFrame:
        return diff.breaking_changes(self.compare_version(from_version, to_version), from_version, to_version)

    def search_migration(self, symbol: str | None = None, from_version: str | None = None, to_version: str | None = None) -> DataFrame:
        conditions = [None if symbol is None else F.contains(F.lower("symbol_name"), F.lower(F.lit(symbol))), None if from_version is None else F.col("from_version") == from_version, None if to_version is None else F.col("to_version") == to_version]
        return relational.all_of(self.tables["breaking_change"], *conditions).withColumn("guide", diff.migration_text()).orderBy("symbol_name", "id")

    def versions(self) -> DataFrame:
        return self.tables["symbol_snapshot"].select("version").distinct().orderBy(F.desc("version"))

    def search_shader(self, query: str | None = None, type: str | None = None, file: str | None = None, stage: str | None = None, script_symbol: str | None = None) -> DataFrame:
        conditions = [
            None if query is None else relational.contains_ci("name", query), None if type is None else F.col("type") == type, None if file is None else relational.contains_ci("file", file),
            None if stage is None else F.col("related_render_stage") == stage, None if script_symbol is None else F.array_contains("related_js_symbols", script_symbol),
        ]
        return relational.all_of(self.tables["shader_symbol"], *conditions).orderBy("name", "id")

    # --- building ---

    def build_experience(self) -> tuple[DataFrame, DataFrame]:
        """Nodes of all closed issues, merged pull requests and posts, and the edges between them."""
        nodes = matching.experience_nodes(self.tables["issues"], self.tables["pull_requests"], self.tables["forum_posts"])
        return nodes, matching.fixes_edges(self.tables["pull_requests"], self.tables["issues"], nodes)

    @staticmethod
    def index_scripts(files: DataFrame) -> dict[str, DataFrame]:
        """Symbols, their source and the calls between them, from files of path and content."""
        found = extract.symbols(files).persist()
        return {"symbols": found.drop("code"), "source_code": extract.source_code(found), "call_edges": extract.call_edges(files, found)}


def _batched(encoder: Encoder):  # noqa: ANN202
    def encode(texts):  # noqa: ANN001, ANN202
        return type(texts)([[float(x) for x in v] for v in encoder(texts.tolist())])

    encode.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return encode


def _packed(frame: DataFrame, name: str, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """One row: the frame's rows as a list of structs in the order of their columns. For what a pack holds, which is small."""
    rows = frame.withColumns(new) if new else frame
    return rows.select(*columns).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

