"""Registered queries of sources and sinks, with their SQL oracles.

What a service would send, and what a tree of files would hold, is made from the smallest tables, whose size does not depend on the
scale.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import folders
from ..operators import diff, graph, mining, relational
from ..sources import feeds, files, knowledge
from ..sources.store import Store
from . import render
from .catalog import _DIFF, _read, _snapshots, _values, query


def _nations(spark: SparkSession, sf: str) -> list[tuple[int, str, int]]:
    """The nations, of which there are 25 at every scale."""
    return [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _read(spark, sf, "nation").orderBy("n_nationkey").limit(100).collect()]


# --- files ----------------------------------------------------------------------------------------------------------

_TREE = {"Source/Core/N{0}.js": "class {1} {{}}", "Source/node_modules/x{0}.js": "x", "Source/.git/y{0}.js": "y", "Build/b{0}.js": "b", "Source/Shaders/S{0}.glsl": "float {1};", "Source/Shaders/T{0}.glsl.js": "export default 'T'", "Source/u{0}.frag": "u", "Other/N{0}.js": "o{0}"}


def _tree(spark: SparkSession, sf: str) -> str:
    root = folders.scratch(spark, "tree")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, name, _ in _nations(spark, sf):
        for path, content in _TREE.items():
            out = fs.create(hadoop.Path(f"{root}/{path.format(k, name)}"))
            out.write(bytearray(content.format(k, name).encode()))
            out.close()
    return root


@query("""
SELECT 'script' AS kind, 'Source/Core/N' || n_nationkey || '.js' AS path, 'class ' || n_name || ' {}' AS content FROM nation UNION ALL SELECT 'script', 'Other/N' || n_nationkey || '.js', 'o' || n_nationkey FROM nation
UNION ALL SELECT 'script below', 'Source/Core/N' || n_nationkey || '.js', 'class ' || n_name || ' {}' FROM nation UNION ALL SELECT 'shader', 'Source/Shaders/S' || n_nationkey || '.glsl', 'float ' || n_name || ';' FROM nation
UNION ALL SELECT 'shader', 'Source/Shaders/T' || n_nationkey || '.glsl.js', 'export default ''T''' FROM nation UNION ALL SELECT 'shader', 'Source/u' || n_nationkey || '.frag', 'u' FROM nation""")
def source_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts and shaders of a tree, without the folders that are never scanned."""
    root = _tree(spark, sf)
    kinds = {"script": files.scripts(spark, root), "script below": files.scripts(spark, root, ("Source/Core",)), "shader": files.shaders(spark, root)}
    out = None
    for kind, frame in kinds.items():
        rows = frame.select(F.lit(kind).alias("kind"), "path", "content")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 's' || n_nationkey AS id, n_name AS name, CAST(n_regionkey AS INTEGER) AS place, CASE WHEN n_nationkey > 0 THEN 's' || (n_nationkey - 1) ELSE '' END AS before, CAST(n_nationkey AS INTEGER) AS ordinal FROM nation")
def knowledge_file(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of a JSON file, checked and in their order."""
    rows = [{"id": f"s{k}", "name": n, "order": r, "dependsOn": [f"s{k - 1}"] if k else []} for k, n, r in _nations(spark, sf)]
    path = Path(tempfile.mkdtemp(prefix="orrery-")) / "stages.json"  # read on the driver, as all knowledge files are
    path.write_text(json.dumps(rows), "utf-8")
    return knowledge.stages(spark, path).select("id", "name", F.col("order").alias("place"), F.array_join("dependsOn", ",").alias("before"), "ordinal")


# --- feeds ----------------------------------------------------------------------------------------------------------


def _service(pages: list[list[dict]]) -> feeds.Fetch:
    """Answers page after page, each with a link to the next."""

    def fetch(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        at = int(url.rsplit("#", 1)[1]) if "#" in url else 0
        link = {"link": f'<http://service/#{at + 1}>; rel="next"'} if at + 1 < len(pages) else {}
        return 200, link, json.dumps(pages[at]).encode()

    return fetch


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS id, 'o/r' AS repo, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_name ELSE '' END AS body, 'bug,r' || n_regionkey AS labels, 'me' AS author, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS updated_at,
(SELECT '2024-01-' || lpad(CAST(max(n_nationkey) + 1 AS VARCHAR), 2, '0') FROM nation WHERE n_nationkey % 5 <> 3) AS latest FROM nation WHERE n_nationkey % 5 <> 3""")
def issue_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Issues pulled page by page; pull requests among them go; the latest change is the next pull's cursor."""
    items = [
        {"id": k, "number": k, "title": n, "body": f"about {n}" if k % 2 == 0 else None, "state": "open", "labels": [{"name": "bug"}, f"r{r}"], "assignees": None, "user": {"login": "me"}, "comments": k, "created_at": "2024", "updated_at": f"2024-01-{k + 1:02}", "closed_at": None, "html_url": "h"}
        | ({"pull_request": {"url": "p"}} if k % 5 == 3 else {})
        for k, n, r in _nations(spark, sf)
    ]
    fetch = _service([items[:10], items[10:20], items[20:]])
    rows = None
    for page in feeds.pages("o", "r", "issues", since="2023", fetch=fetch):
        found = feeds.issue_rows(spark, page, "o/r")
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("id", "repo", "title", "body", F.array_join("labels", ",").alias("labels"), "author", "updated_at", F.lit(feeds.cursor(rows)).alias("latest"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, n_nationkey || ',' || (n_nationkey + 7) AS refs, CAST(n_regionkey AS INTEGER) AS files_changed FROM nation WHERE n_nationkey % 4 <> 1")
def pull_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Merged pull requests with the issues they close."""
    items = [{"id": k, "number": k, "title": n, "body": f"Fixes #{k}, see #99, resolved #{k + 7}", "state": "closed", "merged_at": None if k % 4 == 1 else "2024", "user": None, "labels": ["x"], "review_comments": 2, "changed_files": r, "created_at": "c", "updated_at": "u", "html_url": "h"} for k, n, r in _nations(spark, sf)]
    rows = None
    for page in feeds.pages("o", "r", "pulls", fetch=_service([items[:13], items[13:]])):
        found = feeds.pull_rows(spark, page, "o/r")
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("id", "title", F.array_join(F.col("closing_issue_refs").cast("array<string>"), ",").alias("refs"), "files_changed")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || ' & <b>' AS body, CAST(greatest(0, n_nationkey % 4 - 1) AS INTEGER) AS replies_count, round(CASE WHEN n_nationkey % 3 = 0 THEN 0.9 ELSE 0 END + least(n_nationkey * 20 / 1000, 0.1), 6) AS quality_score, 'http://f/t/slug/' || n_nationkey AS url
FROM nation WHERE NOT (greatest(0, n_nationkey % 4 - 1) < 2 AND n_nationkey * 20 < 200)""")
def forum_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Forum topics that enough people answered or saw, with the text of their first posts."""
    topics = {k: {"id": k, "title": n, "slug": "slug", "posts_count": k % 4, "views": k * 20, "has_accepted_answer": k % 3 == 0, "tags": ["t"], "created_at": "c", "last_posted_at": None} for k, n, _ in _nations(spark, sf)}

    def fetch(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        if "latest" in url:
            page = int(url.rsplit("=", 1)[1])
            return 200, {}, json.dumps({"topic_list": {"topics": [t for t in topics.values() if t["id"] // 10 == page]}}).encode()
        k = int(url.rsplit("/", 1)[1].removesuffix(".json"))
        return 200, {}, json.dumps({"post_stream": {"posts": [{"cooked": f"<p>{topics[k]['title']} &amp;\n <i>&lt;b&gt;</i></p>", "username": "u"}]}}).encode()

    rows = None
    for page in feeds.forum_pages("http://f", 10, fetch):
        found = feeds.topic_rows(spark, page, "http://f")
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("id", "body", "replies_count", F.round("quality_score", 6).alias("quality_score"), "url")


# --- stores and reports ---------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AS repo, 'old' AS title, p_partkey AS number FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey + 100000 AS id, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AS repo, 'same number' AS title, p_partkey AS number FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END, 'new', p_partkey FROM part WHERE p_partkey % 7 = 1 AND p_partkey % 10 <> 0),
h AS (SELECT id, repo, title, number FROM n UNION ALL SELECT id, repo, title, number FROM o WHERE id NOT IN (SELECT id FROM n) AND (repo, number) NOT IN (SELECT (repo, number) FROM n))
SELECT 'issue' AS kind, CAST(id AS VARCHAR) AS key, title AS value FROM h WHERE repo <> 'b' UNION ALL SELECT 'cursor', 'github:o/r', '2024-02' UNION ALL SELECT 'tables', '15', '15'""")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Tables made, rows put in twice by two keys (of new rows with one number the last title stays), one repository cleared, a cursor
    moved on, all read back."""
    store = Store(spark, folders.scratch(spark, "store"))
    store.create()
    store.create()
    k = F.col("p_partkey")
    part = _read(spark, sf, "part", "p_partkey")
    repo = F.when(k % 3 == 0, "b").otherwise("a")

    def issues(rows: DataFrame, key, title: str) -> DataFrame:  # noqa: ANN001
        named = rows.select(key.alias("id"), repo.alias("repo"), k.alias("number"), F.lit(title).alias("title"))
        return named.select(*[F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ISSUES.fields])

    store.upsert("issues", issues(part.where(k % 2 == 0), k, "old"))
    store.upsert("issues", issues(part.where(k % 10 == 0), k + 100_000, "same number").unionByName(issues(part.where(k % 7 == 1), k, "new")), ["title", "id"])
    store.clear("issues", "repo", "b")
    store.set_cursor("github:o/r", "2024-01")
    store.set_cursor("github:o/r", "2024-02")
    held = store.read("issues").select(F.lit("issue").alias("kind"), F.col("id").cast("string").alias("key"), F.col("title").alias("value"))
    made = str(sum(bool(store.versions(n)) for n in schemas.TABLES))
    return held.unionByName(_values(spark, [("cursor", "github:o/r", store.cursor("github:o/r")), ("tables", made, str(len(schemas.TABLES)))], "kind string, key string, value string"))


@query("""
WITH o AS (SELECT n_nationkey AS k, 'v' || n_nationkey AS v, n_nationkey AS c FROM nation WHERE n_nationkey < 15), n AS (SELECT n_nationkey AS k, 'w' || n_nationkey AS v, 100 AS c FROM nation WHERE n_nationkey >= 10)
SELECT 'shader/' || coalesce(o.k, n.k) AS id, coalesce(n.v, o.v) AS source, CAST(coalesce(o.c, n.c) AS BIGINT) AS created_at FROM o FULL JOIN n ON o.k = n.k""")
def store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a stored table updated column by column; when they were made stays."""
    store = Store(spark, folders.scratch(spark, "store"))
    k = F.col("n_nationkey")

    def rows(where: str, letter: str, created) -> DataFrame:  # noqa: ANN001
        named = _read(spark, sf, "nation").where(where).select(F.concat(F.lit("shader/"), k.cast("string")).alias("id"), F.concat(F.lit(letter), k.cast("string")).alias("source"), created.cast("long").alias("created_at"))
        return named.select(*[F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SHADERS.fields])

    store.merge("shader_symbol", rows("n_nationkey < 15", "v", k))
    store.merge("shader_symbol", rows("n_nationkey >= 10", "w", F.lit(100)))
    return store.read("shader_symbol").select("id", "source", "created_at")


@query("SELECT 'p' || n_nationkey AS id, 'candidate/' || n_nationkey AS candidate, CASE WHEN n_nationkey % 2 = 0 THEN 'again' ELSE 'first' END AS name FROM nation UNION ALL SELECT 'conflict', 'p3', 'candidate/3'")
def promoted_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns put into a reviewer's file: twice from one candidate replaces, an id that another candidate has is refused."""
    path = Path(tempfile.mkdtemp(prefix="orrery-")) / "generated.json"  # a reviewer's file, written by the driver
    k = F.col("n_nationkey")

    def entries(name: str, candidate=None) -> DataFrame:  # noqa: ANN001
        own = F.concat(F.lit("candidate/"), k.cast("string"))
        named = _read(spark, sf, "nation").select(k, F.concat(F.lit("p"), k.cast("string")).alias("id"), F.lit(name).alias("name"), (own if candidate is None else candidate).alias("candidateId"))
        return named.select("n_nationkey", *[F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.GENERATED_PATTERNS.fields])

    mining.promote(entries("first").drop("n_nationkey"), path)
    mining.promote(entries("again").where(k % 2 == 0).drop("n_nationkey"), path)
    try:
        mining.promote(entries("other", F.lit("x")).where(k == 3).drop("n_nationkey"), path)
        said = ("conflict", "none", "none")
    except ValueError as e:
        said = ("conflict", str(e).split('"')[1], str(e).split('"')[3])
    held = knowledge.generated(spark, path).select("id", F.col("candidateId").alias("candidate"), "name")
    return held.unionByName(_values(spark, [said], "id string, candidate string, name string"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def written_report(spark: SparkSession, sf: str) -> DataFrame:
    """A small result written as one JSON file and read back."""
    path = folders.scratch(spark, "report")
    render.write_report(relational.counts(_read(spark, sf, "events", "event_type"), "event_type"), path)
    return spark.read.schema("event_type string, n long").json(path)


# --- renderings -----------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation), m AS (SELECT max(r) AS m FROM r),
l AS (SELECT r * 1000 AS o, CASE WHEN r = m THEN '└── ' ELSE '├── ' END || 'region ' || r || ' [static]' AS line FROM (SELECT DISTINCT r FROM r), m UNION ALL
SELECT r * 1000 + k + 1, CASE WHEN r = m THEN '    ' ELSE '│   ' END || CASE WHEN i = c THEN '└── ' ELSE '├── ' END || n || CASE WHEN k % 2 = 0 THEN ' [new]' ELSE '' END FROM r, m UNION ALL SELECT -1, 'world')
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS place, line FROM l""")
def call_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A drawing of a graph below a node, line by line."""
    nations = sorted(_nations(spark, sf), key=lambda r: (r[2], r[0]))
    edges = [("world", f"region {r}", "static_call") for r in sorted({r for *_, r in nations})] + [(f"region {r}", n, "construct" if k % 2 == 0 else "call") for k, n, r in nations]
    return _values(spark, list(enumerate(graph.tree(edges, "world", 5).split("\n"))), "place int, line string")


@query(f"""
{_DIFF}, n AS (SELECT status, count(*) AS n FROM s GROUP BY status), h AS (SELECT string_agg(coalesce(n, 0) || ' ' || z.status, ', ' ORDER BY z.o) AS t FROM (VALUES ('added', 1), ('removed', 2), ('modified', 3), ('unchanged', 4)) AS z(status, o) LEFT JOIN n ON n.status = z.status),
r AS (SELECT status, change_type, name, coalesce(af, bf) AS f, row_number() OVER (PARTITION BY status ORDER BY name, coalesce(af, bf)) AS i, CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS o FROM s WHERE status <> 'unchanged')
SELECT line, count(*) AS n FROM (SELECT '1 -> 2: ' || t AS line FROM h UNION ALL SELECT '  ' || ['+', '-', '~'][o] || ' ' || name || ' (' || CASE WHEN o = 3 THEN '' ELSE 'function' END AS line FROM r WHERE i <= 20 UNION ALL SELECT '  ... and ' || (n - 20) || ' more' FROM n WHERE n > 20 AND status <> 'unchanged') GROUP BY line""")
def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a version diff, line by line; of a changed symbol's line only the name, as equal names and files are in no order."""
    said = render.diff_text(diff.compare(*_snapshots(spark, sf)), "1", "2")
    lines = _values(spark, [(x,) for x in said.split("\n")], "line string")
    name = F.regexp_extract("line", r"^(  ~ .* \()\w+\)", 1)
    plain = F.regexp_extract("line", r"^(  [+-] .* \(function)\)", 1)
    short = F.when(name != "", name).when(plain != "", plain).otherwise(F.col("line"))
    return lines.select(short.alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
