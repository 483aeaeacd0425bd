"""The engine's operators on small hand-made tables, against plain restatements where there are any."""

from __future__ import annotations

import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import schemas
from orrery.functions import text
from orrery.operators import diff, evidence, extract, fts, graph, matching, mining, packing, relational, vectors
from orrery.plans.engine import KnowledgeEngine
from orrery.sources import feeds, files, knowledge
from orrery.sources.store import Store
from orrery.streaming import ingest


def one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def table(spark, name, *rows):
    schema = schemas.TABLES[name][0]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


# --- text -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("raw", "want"), [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("😀😀😀", 2), (None, 0)])
def test_token_estimate(spark, raw, want):
    assert one(spark, raw).select(text.token_estimate("x")).first()[0] == want


def test_text_functions(spark):
    row = one(spark, "Fixes #12 and prefix #7; see Camera and Scene.update or Camera").select(text.closing_references("x").alias("c"), text.symbol_mentions("x").alias("m"), text.query_tokens(F.lit("Why is the z-fighting so BAD, on my map?")).alias("t"), text.safe_id(F.lit("__Hello, World!")).alias("s")).first()
    assert row["c"] == [12, 7] and row["m"] == ["Fixes", "Camera", "Scene"] and row["t"] == ["z-fighting", "bad", "map"] and row["s"] == "hello_world"
    assert one(spark, "<p>a&nbsp;&amp; b</p>\n <i>c</i>").select(text.strip_html("x")).first()[0] == "a & b c"
    assert one(spark, "abcdefgh").select(text.truncate_text("x", 1)).first()[0] == "abcd" + text.TRUNCATED
    assert one(spark, "issue:1001").select(text.point_id("x")).first()[0] == abs(rolling("issue:1001"))


def rolling(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


# --- search ---------------------------------------------------------------------------------------------------------


def test_search_equals_fts5(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), None if i % 7 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, body)")
    db.executemany("insert into t(rowid, title, body) values (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "id long, title string, body string")
    index = fts.Index.build(frame, "id", ["title", "body"])
    for query in ("alpha", "alpha beta", "alpha_beta", "zeta_gamma delta", "nothing", "", "!!!"):
        found = {r["doc_id"]: r["score"] for r in index.scores(query).collect()}
        quoted = " ".join(f'"{w}"' for w in __import__("re").findall(r"\w+", query))
        want = dict(db.execute("select rowid, bm25(t) from t where t match ?", (quoted,)).fetchall()) if quoted else {}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_search_index_is_stored_and_filters_do_not_change_scores(spark, tmp_path):
    issues = spark.createDataFrame([(1, "alpha", "open"), (2, "alpha beta", "closed"), (3, "beta", "open"), (4, "Café", "open")], "id long, title string, state string")
    fts.Index.build(issues, "id", ["title"], fold=True).write(str(tmp_path / "index"))
    index = fts.Index.read(spark, str(tmp_path / "index"))
    every = {r["id"]: r["score"] for r in fts.search(index, issues, "id", "alpha").collect()}
    closed = {r["id"]: r["score"] for r in fts.search(index, issues, "id", "alpha", condition=F.col("state") == "closed").collect()}
    assert closed == {2: every[2]} and fts.search(index, issues, "id", "cafe").count() == 1
    shown = issues.select(fts.snippet("title", "beta")).collect()
    assert shown[1][0] == "alpha >>>beta<<<"


# --- tables ---------------------------------------------------------------------------------------------------------


def test_store_upserts_by_both_keys_and_keeps_cursors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.create()
    issue = lambda i, n, title: dict(id=i, repo="r", number=n, title=title, state="open", updated_at="2024")
    store.upsert("issues", table(spark, "issues", issue(1, 101, "a"), issue(2, 102, "b")))
    store.upsert("issues", table(spark, "issues", issue(1, 101, "A"), issue(9, 102, "moved")))
    assert sorted((r["id"], r["title"]) for r in store.read("issues").collect()) == [(1, "A"), (9, "moved")]
    assert store.cursor("r") is None
    store.set_cursor("r", "x")
    store.set_cursor("r", "y")
    assert store.cursor("r") == "y" and len(store.versions("issues")) == 2
    store.clear("issues", "repo", "r")
    assert store.read("issues").count() == 0


def test_merge_keeps_creation(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, v int, created_at int")
    new = spark.createDataFrame([("a", None, 99), ("c", 3, 30)], "id string, v int, created_at int")
    assert sorted(tuple(r) for r in relational.merge(old, new, ["id"]).collect()) == [("a", 1, 10), ("b", 2, 20), ("c", 3, 30)]


def test_resolution_of_names(spark):
    symbols = spark.createDataFrame([("1", "update", "method", "Camera"), ("2", "Camera", "function", None), ("3", "Camera", "class", None)], "id string, name string, kind string, parent_class string")
    wanted = spark.createDataFrame([("Camera.update",), ("Camera.nope",), ("Camera",)], "query string")
    assert {r["query"]: r["id"] for r in relational.resolve_names(wanted, symbols).collect()} == {"Camera.update": "1", "Camera": "3"}


# --- graphs ---------------------------------------------------------------------------------------------------------


def naive(edges, root, depth):
    depths, frontier = {root: 0}, [root]
    for d in range(1, depth + 1):
        frontier = [b for a, b in edges if a in frontier and b not in depths and not depths.setdefault(b, d) == -1]
    return sorted((a, b, depths[a] + 1) for a, b in edges if depths.get(a, depth) < depth)


def test_searches_equal_naive_ones(spark):
    rng = random.Random(3)
    for _ in range(2):
        edges = sorted({(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(14)})
        frame = spark.createDataFrame(edges, "source_id string, target_id string")
        for depth in (1, 3):
            found = sorted(tuple(r) for r in graph.downstream(frame, one(spark, "n0", "id string"), depth).collect())
            assert found == naive(edges, "n0", depth)


def test_stage_graphs(spark):
    stages = knowledge.stages(spark)
    assert graph.is_acyclic(stages)
    assert {r["id"] for r in graph.reachable(stages, "select", down=False).collect()} == {"input", "update"}
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], "id string, dependsOn array<string>")
    assert not graph.is_acyclic(loop)
    drawn = graph.tree([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "a", 5)
    assert drawn.count("b") == 1 and "a (circular)" in drawn


# --- vectors --------------------------------------------------------------------------------------------------------


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 2.0], 0), ([1.0, 0.0], [-3.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], 0), ([1.0], [1.0, 0.0], 0)]
    found = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<double>, b array<double>").select(vectors.cosine("a", "b")).collect()
    assert [r[0] for r in found] == [w for *_, w in rows]


def test_clusters_by_component_equal_global_ones(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    x = [centre[rng.integers(6)] + rng.normal(size=8) * 0.35 for _ in range(60)]
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    for least, most in ((2, None), (3, 4)):
        found: dict = {}
        for r in vectors.clusters(frame, 0.85, least, most).collect():
            found.setdefault(r["cluster_id"], []).append((r["position"], r["id"]))
        assert sorted([i for _, i in sorted(c)] for c in found.values()) == sorted(vectors.greedy_clusters(x, 0.85, least, most))


def test_duplicates_and_references(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0, 0.0])], "id string, vector array<double>")
    assert [(r["source_node_id"], r["target_node_id"]) for r in vectors.reference_edges(points, 0.9).collect()] == [("a", "b")]
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [1.0])], "id string, vector array<double>")
    assert {r["id"]: (r["best_id"], r["dup_of"]) for r in vectors.duplicates(asked, points, 0.9).collect()} == {"q": ("a", "a"), "z": (None, None)}


# --- rules ----------------------------------------------------------------------------------------------------------

QUESTIONS = [
    ("polygons flicker, looks like z fighting", "depth_conflict"),
    ("very low fps with many entities", "slow_frames"),
    ("tileset has missing tiles", "missing_tiles"),
    ("model floats over the terrain", "terrain_gap"),
    ("glsl error after update", "shader_error"),
    ("camera jump at the pole", "camera_jump"),
]


def test_acceptance_questions(spark):
    asked = spark.createDataFrame([(q, q) for q, _ in QUESTIONS], "query_id string, question string")
    best = {r["query_id"]: r["id"] for r in matching.match_patterns(asked, knowledge.patterns(spark), 1).collect()}
    assert best == dict(QUESTIONS)


def test_weak_evidence_alone_does_not_match(spark):
    patterns = knowledge.patterns(spark)
    asked = spark.createDataFrame([("a", "Primitive"), ("b", "nothing here")], "query_id string, question string")
    assert matching.match_patterns(asked, patterns).count() == 0
    for score, n in ((0.74, 0), (0.75, 1)):
        given = spark.createDataFrame([("b", "slow_frames", score)], "query_id string, id string, vector_score double")
        found = matching.match_patterns(asked, patterns, vector_scores=given)
        assert found.count() == n and all(r["matched"] == ["vector:0.750"] for r in found.collect())


def test_intents(spark):
    rows = [("Crash", "it fails", None), ("Crash", "it fails", ["Feature", " BUG "]), ("Please", "add support for x", []), ("", None, None), ("z-fighting", "", None)]
    found = matching.intents(spark.createDataFrame(rows, "title string, body string, labels array<string>")).collect()
    assert [(r["intent"], round(r["confidence"], 3)) for r in found] == [("bug", 0.62), ("bug", 0.95), ("feature_request", 0.62), ("unknown", 0.1), ("bug", 0.62)]


def test_skills_and_entities(spark):
    engine = KnowledgeEngine(spark, {"symbols": table(spark, "symbols", dict(id="1", name="Camera", kind="class"))})
    found = [(r["type"], r["value"]) for r in engine.entities("Since 1.104 the Camera.flyTo has jagged ground and low fps, Nobody").where("value <> 'camera_jump'").orderBy("position").collect()]
    assert found == [("version", "1.104"), ("stage", "terrain"), ("problem", "slow_frames"), ("symbol", "Camera")]
    assert engine.dispatch_skill("zzz").first()["skill"] == "general"
    assert engine.dispatch_skill("glsl shader uniform").first()["skill"] == "shader"


def test_evidence(spark):
    rows = [("q", "shader", "s", "d", 1.0, "", 2), ("q", "pattern", "p", "d", 0.9, "", 1), ("q", "symbol", "y", "d", 1.0, "class", 3)]
    ranked = evidence.rank(spark.createDataFrame(rows, "query_id string, type string, source string, description string, weight double, kind string, ordinal long"))
    assert [(r["source"], r["score"]) for r in ranked.orderBy("rank").collect()] == [("p", 0.9), ("y", 0.8), ("s", 0.6)]
    said = evidence.explain(spark.createDataFrame([("q",), ("none",)], "query_id string"), ranked).orderBy("query_id").collect()
    assert said[0]["confidence"] == 0 and said[1]["confidence"] == 1.0 and len(said[1]["contributing_factors"]) == 2 and len(said[1]["suggested_actions"]) == 4


# --- packs ----------------------------------------------------------------------------------------------------------


def context(spark, sources, issues, edges=0, doc=None):
    none = "struct<id:string,name:string,doc_comment:string,exports:array<string>,imports:array<string>,parent_class:string>"
    schema = f"symbol {none}, source array<struct<symbol_id:string,code:string>>, callgraph array<struct<a:string,b:string>>, issues array<struct<title:string,body:string>>"
    row = (("i", "n", doc, [], [], "C"), [("s", c) for c in sources], [("a" * 10, "b" * 10)] * edges, [("t", b) for b in issues])
    return spark.createDataFrame([row], schema)


def test_context_pack_caps_and_budget(spark):
    kept = packing.context_pack(context(spark, ["m" * 400, "d" * 400], ["b" * 40], 2), 5000).first()
    assert not kept["truncated"] and len(kept["source"]) == 2 and kept["symbol_resolved"] == "C.n"
    cut = packing.context_pack(context(spark, ["m" * 4000, "d" * 9000, "e" * 400], []), 50000).first()
    assert cut["truncated"] and [len(s["code"]) for s in cut["source"]] == [4000, (3000 - 1020 - 20) * 4 + len(text.TRUNCATED)]
    small = packing.context_pack(context(spark, ["m" * 8000, "d" * 400], ["b" * 400], 30, "doc"), 300).first()
    assert small["total_tokens"] <= 300 + 10 and len(small["source"]) == 1 and small["issues"] == []
    least = packing.context_pack(context(spark, ["m" * 400], [], 0, "x" * 400), 1).first()
    assert least["unavoidable_overflow"] and least["minimum_possible_tokens"] == least["total_tokens"]


def test_prefix_equals_popping(spark):
    rng = random.Random(8)
    rows = [([rng.randrange(30) for _ in range(rng.randrange(7))], rng.randrange(-5, 90)) for _ in range(60)]
    found = spark.createDataFrame(rows, "c array<int>, room int").select(packing.prefix_within(F.col("c"), F.col("room"))).collect()
    for (costs, room), (n,) in zip(rows, found):
        while costs and sum(costs) > room:
            costs = costs[:-1]
        assert n == len(costs)


# --- code -----------------------------------------------------------------------------------------------------------

SCRIPT = '''import A from "./A.js";
/**
 * Moves things.
 * @constructor
 */
class Scene {
  constructor() { this.camera = new Camera(); }
  /** Runs. */
  update(t) {
    this.render();
    Matrix.multiply(t, "new Fake(");
    helper();
    thing.special();
  }
  render() {}
  _hidden() { this.render(); }
}
/** @alias Camera */
function CameraConstructor() {}
Camera.prototype.flyTo = function (x) {
  return Matrix.clone(x);
};
/** @enum */
const Mode = Object.freeze({ A: 1 });
export function exported(a) { return new Scene(a); }
function notExported() {}
export const LIMIT = 3;
export default Scene;
'''
MATRIX = "export class Matrix {\n  static multiply(a, b) {}\n  static clone(a) {}\n}\nexport class Thing {\n  special() {}\n}\n"


def test_script_symbols():
    found = {(s["name"], s["kind"], s["parent_class"]) for s in extract.script_symbols(SCRIPT)}
    assert found == {("Scene", "class", None), ("update", "method", "Scene"), ("render", "method", "Scene"), ("Camera", "class", None), ("flyTo", "method", "Camera"), ("Mode", "enum", None), ("exported", "function", None), ("LIMIT", "constant", None)}
    scene = extract.script_symbols(SCRIPT)[0]
    assert scene["doc_comment"] == "Moves things." and scene["start_line"] == 6 and scene["end_line"] == 17 and scene["imports"] == ["./A.js"] and "LIMIT" in scene["exports"]


def test_call_edges(spark):
    sources = spark.createDataFrame([("Source/Scene.js", SCRIPT), ("Source/Matrix.js", MATRIX)], "path string, content string")
    out = KnowledgeEngine.index_scripts(sources)
    names = {r["id"]: r["name"] for r in out["symbols"].collect()}
    edges = {(r["source_name"], r["target_name"], r["edge_type"]) for r in out["call_edges"].collect()}
    assert edges == {("Scene", "Camera", "construct"), ("Scene.update", "Scene.render", "call"), ("Scene.update", "Matrix.multiply", "static_call"), ("Scene.update", "Thing.special", "call"), ("Camera.flyTo", "Matrix.clone", "static_call"), ("exported", "Scene", "construct")}
    assert len(names) == out["symbols"].count()


SHADER = "uniform vec3 u_a;\n/**\n * Lights.\n */\nvec4 light(vec3 n)\n{\n  if (x) { y; }\n  return n;\n}\nin vec2 v_b;\nstruct S {\n  float a;\n};\n#define PI 3.14\nconst float E = 2.7;\n"


def test_shaders(spark):
    found = extract.shader_symbols(SHADER, "/x/Source/Shaders/Model/Light.glsl")
    assert [(s["name"], s["type"]) for s in found] == [("u_a", "uniform"), ("light", "function"), ("v_b", "varying"), ("S", "struct"), ("PI", "define"), ("E", "const")]
    assert "Lights." in found[1]["doc_comment"] and found[1]["end_line"] == 9 and found[0]["file"] == "Source/Shaders/Model/Light.glsl"
    frame = extract.shaders(spark.createDataFrame([("Source/Shaders/Model/czm.glsl", "uniform vec3 czm_material;\nfloat widget(int a) {}\n"), ("x/Globe/other.glsl", "float q(int a) {}")], "path string, content string"))
    scripts = spark.createDataFrame([("1", "Material", "a/Material.js", 1), ("2", "Widget", "a/W.js", 1), ("3", "Tile", "src/Globe/Tile.js", 1)], "id string, name string, file_path string, start_line int")
    linked = {r["name"]: (r["related_js_symbols"], r["related_render_stage"]) for r in extract.link_shaders(frame, scripts).collect()}
    assert linked == {"czm_material": (["1"], "model"), "widget": (["2"], "model"), "q": ([], None)} or linked["q"][0] in ([], ["3"])


def test_versions(spark):
    sources = lambda body, extra: spark.createDataFrame([("Source/Core/Pick.js", f"/** Doc {body} */\nexport function createRay(a) {{\n  return {body};\n}}\n{extra}")], "path string, content string")
    old = diff.snapshot(extract.version_symbols(sources("1", "export function oldOne() {\n}\n")), "1")
    new = diff.snapshot(extract.version_symbols(sources("2", "export function newOne() {\n}\n")), "2")
    changes = {(r["a_name"] or r["b_name"]): (r["status"], r["change_type"]) for r in diff.compare(old, new).collect()}
    assert changes == {"createRay": ("modified", "doc"), "oldOne": ("removed", None), "newOne": ("added", None)}
    broken = diff.breaking_changes(diff.compare(old, new), "1", "2")
    assert [(r["symbol_name"], r["change_type"]) for r in broken.collect()] == [("oldOne", "removed")]
    assert "## oldOne is gone" in diff.migration_guide(broken).first()["guide"]


def test_files(spark, tmp_path):
    for name in ("Source/a.js", "Source/b.glsl", "Source/c.glsl.js", "node_modules/x.js", ".git/y.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r["path"] for r in files.scripts(spark, str(tmp_path)).collect()] == ["Source/a.js"]
    assert sorted(r["path"] for r in files.shaders(spark, str(tmp_path)).collect()) == ["Source/b.glsl", "Source/c.glsl.js"]


# --- feeds and mining -----------------------------------------------------------------------------------------------


def issue_json(n, **more):
    return dict(id=n, number=n, title=f"t{n}", body=None, state="open", labels=[{"name": "bug"}, "x"], assignees=None, user={"login": "u"}, comments=1, created_at="2024-01-01", updated_at=f"2024-01-0{n}", closed_at=None, html_url="h") | more


def test_feeds(spark):
    answers = {0: (200, {"link": '<http://next>; rel="next"'}, json.dumps([issue_json(1), issue_json(2, pull_request={"url": "x"})]).encode()), 1: (200, {}, json.dumps([issue_json(3)]).encode())}
    calls = []
    fetch = lambda url, headers: (calls.append(url), answers[len(calls) - 1])[1]
    found = [feeds.issue_rows(spark, p, "o/r") for p in feeds.pages("o", "r", "issues", since="2023", fetch=fetch)]
    assert [f.count() for f in found] == [1, 1] and "since=2023" in calls[0] and calls[1] == "http://next"
    assert found[0].first()["labels"] == ["bug", "x"] and found[0].first()["body"] == "" and feeds.cursor(found[1]) == "2024-01-03"
    with pytest.raises(feeds.RateLimitError):
        feeds.fetch_json("u", fetch=lambda u, h: (403, {"x-ratelimit-reset": "1"}, b""))
    with pytest.raises(feeds.ApiError):
        feeds.fetch_json("u", fetch=lambda u, h: (500, {}, b"no"))
    pulls = feeds.pull_rows(spark, [issue_json(4, merged_at="2024", body="closes #5", review_comments=1, changed_files=2), issue_json(5, merged_at=None)], "o/r")
    assert [r["closing_issue_refs"] for r in pulls.collect()] == [[5]]
    topics = feeds.topic_rows(spark, [dict(id=1, title="t", slug="s", posts_count=5, views=300, has_accepted_answer=True, tags=None, created_at="c", last_posted_at=None, detail={"post_stream": {"posts": [{"cooked": "<p>hi</p>", "username": "u"}]}}), dict(id=2, title="t", slug="s", posts_count=1, views=3)], "http://f")
    row = topics.first()
    assert topics.count() == 1 and row["body"] == "hi" and row["quality_score"] == 1.0 and row["url"] == "http://f/t/s/1" and row["replies_count"] == 4


class Canned:
    def complete(self, prompt):
        if "boom" in prompt:
            raise OSError("down")
        return '```json\n{"draftAlias": ["A b"], "draftSymptoms": ["s"], "draftSymbols": [], "draftCategory": "odd"}\n```'


def test_mining_from_issues_to_promotion(spark, tmp_path):
    issues = spark.createDataFrame([(1, "crash a", "x", ["bug"], "2024"), (2, "crash b", "y", ["bug"], "2024"), (3, "feature", "z", ["feature"], "2024"), (4, "boom", "", ["bug"], "2024"), (5, "boom", "", ["bug"], "2024")], "id long, title string, body string, labels array<string>, updated_at string")
    points = spark.createDataFrame([(f"issue:{i}", v) for i, v in ((1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0]))], "id string, vector array<float>")
    patterns = spark.createDataFrame([("p", vectors.hashed_embedding("A b s"))], "id string, vector array<float>")
    out = mining.run(issues, points, patterns, Canned())
    rows = {tuple(r["draft_alias"]): r for r in out["candidates"].collect()}
    assert rows[("A b",)]["dup_of"] == "p" and rows[("A b",)]["source_count"] == 2 and rows[()]["failed_draft"]
    approved = relational.set_status(out["candidates"], [rows[("A b",)]["id"]], "approved")
    new = mining.generated_patterns(approved, out["problems"])
    path = tmp_path / "generated.json"
    assert mining.promote(new, path) == 1 and mining.promote(new, path) == 1
    held = json.loads(path.read_text())
    assert len(held) == 1 and held[0]["id"] == "a_b" and held[0]["category"] == "debug"
    with pytest.raises(ValueError, match="conflict"):
        mining.promote(new.withColumn("candidateId", F.lit("other")), path)
    assert {r["status"] for r in diff.pattern_drift(new, knowledge.patterns(spark)).collect()} == {"added"}
    with pytest.raises(ValueError, match="no issues"):
        mining.run(issues.where("id = 3"), points, patterns, Canned())


def test_answers_are_parsed(spark):
    said = ['{"intent": "bug", "confidence": 2}', "```json\n{\"intent\": \"odd\"}\n```", "it is a Bug", "new feature", "?", "ERROR: down"]
    found = spark.createDataFrame([(s,) for s in said], "x string").select(mining.parse_intent("x").alias("i")).select("i.*").collect()
    assert [(r["intent"], r["confidence"]) for r in found] == [("bug", 1.0), ("unknown", 0.5), ("bug", 0.6), ("feature_request", 0.5), ("unknown", 0.2), ("unknown", 0.1)]


def test_knowledge_is_checked(tmp_path, spark):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": "a", "name": "", "dependsOn": ["b"]}, {"id": "a", "name": "x"}]))
    with pytest.raises(knowledge.KnowledgeError, match="unknown stage"):
        knowledge.stages(spark, path)
    path.write_text(json.dumps([{"id": "debug", "tokenBudget": 0}]))
    with pytest.raises(knowledge.KnowledgeError, match="general"):
        knowledge.skills(spark, path)


# --- engine and streams ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def engine(spark):
    scripts = spark.createDataFrame([("Source/Scene.js", SCRIPT), ("Source/Matrix.js", MATRIX)], "path string, content string")
    issue = lambda i, title, body: dict(id=i, repo="r", number=i, title=title, body=body, state="closed" if i % 2 else "open", comments=9, labels=[], created_at="c")
    pulls = table(spark, "pull_requests", dict(id=7, repo="r", number=7, title="Fix Scene", body="fixes #1", state="closed", merged_at="m", labels=[], review_comments=5, closing_issue_refs=[1]))
    tables = KnowledgeEngine.index_scripts(scripts) | {"issues": table(spark, "issues", issue(1, "Scene flicker", "overlapping polygons flicker"), issue(2, "Scene", "other")), "pull_requests": pulls}
    first = KnowledgeEngine(spark, tables)
    nodes, edges = first.build_experience()
    edge_table = edges.withColumns({"created_at": F.lit("c"), "metadata": F.lit(None).cast("map<string,string>")})
    return KnowledgeEngine(spark, tables | {"experience_node": nodes.cache(), "experience_edge": edge_table.cache(), "shader_symbol": table(spark, "shader_symbol", dict(id="shader/a", name="flickerFix", type="function", file="f"))})


def test_tools(engine):
    assert engine.search_symbol("Scene").first()["name"] == "Scene"
    scene = engine.tables["symbols"].where("name = 'Scene'").first()["id"]
    assert "class Scene" in engine.get_source(scene).first()["code"]
    assert ">>>special<<<" in engine.search_source("special").first()["snippet"]
    assert [r["number"] for r in engine.search_issue("scene", state="open").collect()] == [2]
    assert engine.trace_callgraph("Scene.update").count() == 3
    assert engine.trace_callgraph("Matrix.clone", "up").count() >= 1
    edges, nodes = engine.get_experience_chain("issue:1")
    assert [r["id"] for r in edges.collect()] == ["fixes:pr_review:7:issue:1"] and nodes.count() == 2
    assert [r["id"] for r in engine.query_render_stage(problem="missing_tiles").collect()] == ["select"]
    assert engine.search_experience("flicker", type="issue").count() == 1
    assert engine.search_shader("FLICKER").count() == 1 and engine.search_shader("FLICKER", type="uniform").count() == 0
    assert engine.search_forum("x").count() == 0 and engine.semantic_search_experience("x").count() == 0
    assert engine.compare_version("1", "2").count() == 0 and engine.search_migration("x").count() == 0
    assert engine.diagnose_root_cause("surface flicker").first()["primary_cause"].endswith("depth_conflict")


def test_packs_of_the_engine(engine):
    pack = engine.build_context_pack("Scene.update").first()
    assert pack["symbol"]["name"] == "update" and len(pack["source"]) >= 2 and len(pack["issues"]) == 2
    found = engine.diagnose_problem("surface flicker in the scene").first()
    assert found["matched_patterns"][0]["id"] == "depth_conflict" and found["related_issues"][0]["number"] == 1 and found["total_tokens"] <= 6000
    assert [s["id"] for s in found["render_stages"]] == ["depth"] and found["fix_suggestions"]
    small = engine.diagnose_problem("surface flicker in the scene", budget=120).first()
    assert small["truncated"] and small["total_tokens"] < found["total_tokens"]
    skill = engine.build_skill_pack("flicker bug in Scene.update").first()
    assert skill["dispatch"]["skill"] == "debug" and skill["matched_patterns"] and skill["total_tokens"] <= 6000


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    feed = tmp_path / "in"
    feed.mkdir()
    line = lambda n, title: json.dumps(dict(id=n, repo="r", number=n, title=title, updated_at=title))
    (feed / "1.json").write_text(line(1, "a") + "\n" + line(2, "b"))
    run = lambda: ingest.upserts(ingest.changes(spark, str(feed), schemas.ISSUES), store, "issues", ["updated_at"], str(tmp_path / "check")).awaitTermination()
    run()
    (feed / "2.json").write_text(line(1, "c"))
    run()
    run()
    assert sorted((r["id"], r["title"]) for r in store.read("issues").collect()) == [(1, "c"), (2, "b")]
    events = ingest.changes(spark, str(feed), schemas.ISSUES).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert ingest.windowed_counts(events, "at", "repo").isStreaming
