"""Explicit schemas of every table the engine keeps; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
        "strings": T.ArrayType(T.StringType()), "longs": T.ArrayType(T.LongType()), "floats": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType()),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


SYMBOLS = _schema("id string, name string, kind string, file_path string, start_line int, end_line int, doc_comment string, exports strings, imports strings, parent_class string")
SOURCE_CODE = _schema("symbol_id string, name string, file_path string, start_line int, end_line int, code string")
ISSUES = _schema("id long, repo string, number long, title string, body string, state string, labels strings, assignees strings, author string, comments int, created_at string, updated_at string, closed_at string, html_url string")
PULL_REQUESTS = _schema("id long, repo string, number long, title string, body string, state string, merged_at string, author string, labels strings, review_comments int, files_changed int, created_at string, updated_at string, html_url string, closing_issue_refs longs")
FORUM_POSTS = _schema("id long, topic_id long, title string, body string, author string, replies_count int, views_count int, has_solution boolean, tags strings, created_at string, updated_at string, url string, quality_score double")
EXPERIENCE_NODES = _schema("id string, type string, title string, url string, source string, summary string, related_symbols strings, tags strings, quality_score double, published_at string")
EXPERIENCE_EDGES = _schema("id string, source_node_id string, target_node_id string, edge_type string, confidence double, created_at string, metadata map")
CALL_EDGES = _schema("source_id string, target_id string, source_name string, target_name string, edge_type string, weight double")
META = _schema("key string, value string")
SNAPSHOTS = _schema("id string, version string, symbol_id string, name string, kind string, file_path string, start_line int, end_line int, doc_comment string, source_hash string, snapshot_at long")
BREAKING_CHANGES = _schema("id string, from_version string, to_version string, symbol_id string, symbol_name string, change_type string, description string, migration_guide string, created_at long")
SHADERS = _schema("id string, name string, type string, file string, source string, related_js_symbols strings, related_render_stage string, doc_comment string, start_line int, end_line int, created_at long")
CANONICAL_PROBLEMS = _schema("id string, title string, aliases strings, representative_issue_id string, cluster_ids strings, experience_ids strings, confidence double, status string, created_at long, reviewed_at long")
CANDIDATES = _schema("id string, canonical_id string, cluster_id string, draft_alias strings, draft_symptoms strings, draft_symbols strings, draft_category string, llm_raw string, quality_score double, dup_of string, failed_draft boolean, status string, reviewed_at long, created_at long, source_count int, issue_count int, forum_count int, experience_count int")
VECTORS = _schema("id string, vector floats, type string, project string, node_type string, node_id string, title string, url string, repo string, tags strings, labels strings, importance double, status string")
PATTERNS = _schema("id string, name string, category string, severity string, aliases strings, triggerKeywords strings, symptoms strings, possibleCauses strings, relatedSymbols strings, relatedStages strings, issueQueries strings, investigationSteps strings, fixSuggestions strings")
GENERATED_PATTERNS = T.StructType([*PATTERNS.fields, *_schema("candidateId string, canonicalId string, clusterId string, promotedAt string, sourceCount int").fields])
STAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("order", T.IntegerType()), *_schema("description string, keySymbols strings, symptomHints strings, dependsOn strings, perfHotspot boolean, isOptional boolean").fields])
SKILLS = T.StructType([
    *_schema("id string, name string, description string, triggerKeywords strings, tokenBudget int, sections strings").fields,
    T.StructField("retrieval", _schema("includeDiagnosis boolean, includeRenderStages boolean, includeForum boolean, includeExperience boolean, callgraphDepth int, issueLimit int, forumLimit int")),
])

#: Table name: (schema, the columns that name a row).
TABLES = {
    "symbols": (SYMBOLS, ["id"]), "source_code": (SOURCE_CODE, ["symbol_id"]), "issues": (ISSUES, ["id"]), "pull_requests": (PULL_REQUESTS, ["id"]), "forum_posts": (FORUM_POSTS, ["id"]),
    "experience_node": (EXPERIENCE_NODES, ["id"]), "experience_edge": (EXPERIENCE_EDGES, ["id"]), "call_edges": (CALL_EDGES, ["source_id", "target_id", "edge_type"]), "meta": (META, ["key"]),
    "symbol_snapshot": (SNAPSHOTS, ["version", "symbol_id"]), "breaking_change": (BREAKING_CHANGES, ["id"]), "shader_symbol": (SHADERS, ["id"]),
    "canonical_problem": (CANONICAL_PROBLEMS, ["id"]), "problem_candidate": (CANDIDATES, ["id"]), "vectors": (VECTORS, ["id"]),
}
#: Tables with a second unique key.
ALSO_UNIQUE = {"issues": ["repo", "number"], "pull_requests": ["repo", "number"], "experience_edge": ["source_node_id", "target_node_id", "edge_type"]}
