"""Points of the knowledge base, renderings and the command line."""

from __future__ import annotations

import json

from orrery import __main__ as command
from orrery import schemas
from orrery.operators import extract, relational, vectors
from orrery.plans import render
from orrery.plans.engine import KnowledgeEngine
from orrery.sources import knowledge


def test_knowledge_points(spark):
    issues = spark.createDataFrame([(1, "r", 1, "Crash", " a\n b ", "open", ["bug"], [], "u", 1, "c", "u", None, "h")], schemas.ISSUES)
    points = vectors.knowledge_points(None, issues, knowledge.patterns(spark), knowledge.stages(spark))
    rows = {r["id"]: r for r in points.collect()}
    assert rows["issue:1"]["importance"] == 0.5 and rows["pattern:depth_conflict"]["importance"] == 3 and rows["stage:input"]["importance"] == 1
    assert [f.name for f in points.schema.fields] == schemas.VECTORS.names
    engine = KnowledgeEngine(spark, {"vectors": points})
    assert engine.search_knowledge_base("surface flicker", 1).count() == 1
    assert engine.match("surface flicker z-fighting", hybrid=True).orderBy("score", ascending=False).first()["id"] == "depth_conflict"


def test_display_order_and_call_stats(spark):
    symbols = spark.createDataFrame([("b", "x/b.js", "method"), ("a", "x/c.js", "class"), ("c", "x/c.js", "constant")], "name string, file_path string, kind string")
    assert [r["name"] for r in symbols.orderBy(*relational.display_order()).collect()] == ["b", "c", "a"]
    sources = spark.createDataFrame([("a.js", "export class A {\n  b() { this.c(); d(); }\n  c() {}\n}\n")], "path string, content string")
    assert {r["outcome"]: r["n"] for r in extract.call_stats(sources, extract.symbols(sources)).collect()} == {"form:this": 1, "form:bare": 1, "edge:call": 1}


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    (root / "Source").mkdir(parents=True)
    (root / "Source/Scene.js").write_text("/** Draws. */\nexport class Scene {\n  update() { this.render(); }\n  render() {}\n}\n")
    (root / "Source/x.glsl").write_text("uniform float u_x;\n")
    db = str(tmp_path / "db")
    command.main(["init", "--db", db])
    command.main(["index", "--db", db, "--root", str(root)])
    command.main(["trace_callgraph", "--db", db, "--symbol", "Scene.update", "--depth", "1"])
    assert json.loads(capsys.readouterr().out.strip())["target_name"] == "Scene.render"
    command.main(["search_shader", "--db", db, "--query", "U_X"])
    assert json.loads(capsys.readouterr().out.strip())["name"] == "u_x"


def test_versions_and_trees_on_the_command_line(spark, tmp_path, capsys):
    source = tmp_path / "tree/Source"
    source.mkdir(parents=True)
    db, root = str(tmp_path / "db"), str(tmp_path / "tree")
    (source / "Scene.js").write_text("export class Scene {\n  update() { this.render(); new Pass(); }\n  render() {}\n}\nexport class Pass {\n}\n")
    command.main(["init", "--db", db])
    command.main(["index", "--db", db, "--root", root])
    command.main(["snapshot", "--db", db, "--root", root, "--version", "1"])
    (source / "Scene.js").write_text("export class Scene {\n  update() {\n    this.draw();\n  }\n  draw() {}\n}\n")
    command.main(["snapshot", "--db", db, "--root", root, "--version", "2"])
    command.main(["tree", "--db", db, "--symbol", "Scene.update"])
    assert set(capsys.readouterr().out.replace("└", "├").strip().split("\n")) == {"Scene.update", "├── Scene.render", "├── Pass [new]"}
    command.main(["diff", "--db", db, "--from", "1", "--to", "2"])
    said = capsys.readouterr().out
    assert said.startswith("1 -> 2: 1 added, 2 removed, 2 modified, 0 unchanged") and "  + draw (method)" in said and "  - Pass (class)" in said
    command.main(["diff", "--db", db, "--from", "1", "--to", "2", "--format", "json"])
    assert json.loads(capsys.readouterr().out)["stats"]["removed"] == 2
    command.main(["review", "--db", db])
    assert capsys.readouterr().out.strip() == "no pending candidates here"


def test_renderings(spark):
    engine = KnowledgeEngine(spark, {})
    said = engine.diagnose_root_cause("z fighting flicker").first().asDict()
    assert "Confidence: 100%" in render.explanation_text("q", said)
    assert "- added: 0" in render.diff_markdown(engine.compare_version("1", "2"), "1", "2")
