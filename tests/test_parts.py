"""Parts of the engine's operators against plain restatements, and their defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import evidence, extract, fts, graph, matching, mining, vectors
from orrery.plans import render

PATTERNS = "id string, name string, category string, aliases array<string>, triggerKeywords array<string>, symptoms array<string>, relatedSymbols array<string>, ordinal int"


def test_patterns_meet_by_terms_as_they_do_on_every_executor(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("sun moon sea-side tide rock-pool sand wave gull".split())
    some = lambda n, k=1: [" ".join(word() for _ in range(k)) for _ in range(rng.randrange(n))]
    patterns = spark.createDataFrame([(f"p{i}", "n", word(), some(3, 2), some(3), some(3, 3), some(3), i) for i in range(30)] + [("none", None, None, None, None, None, None, 99)], PATTERNS)
    asked = spark.createDataFrame([(i, None if i == 0 else "" if i == 1 else " ".join(word() for _ in range(rng.randrange(9)))) for i in range(60)], "query_id int, question string")
    scores = spark.createDataFrame([(i, f"p{i % 30}", 0.5 + i % 3 / 5) for i in range(60)], "query_id int, id string, vector_score double")
    for given in (None, scores):
        every = matching.match_patterns(asked, patterns, 5, given)
        few = matching.match_patterns(asked, patterns, 5, given, most_bytes=0)
        show = lambda f: sorted(map(str, f.select("query_id", "id", "score", "rank", "matched").collect()))
        assert show(every) == show(few) and every.count() > 30
        kinds = {m.split(":")[0] for r in every.select("matched").collect() for m in r["matched"]}
        assert kinds == {"alias", "keyword", "symptom", "symbol", "category"} | ({"vector"} if given else set())
    assert {r[0] for r in every.select("query_id").collect()}.isdisjoint({0} if given is None else set())


def test_texts_are_cut_by_units_of_sixteen_bits(spark):
    rows = ["a" * 50, "😀" * 50, "a😀" * 30, "é" * 41, "", None]
    found = spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.truncate_text("x", 10).alias("cut"), text.truncate_text("x", 0).alias("none")).collect()
    for r in found:
        if r["x"] is None:
            continue
        assert r["none"] == ""
        units = lambda s: len(s.encode("utf-16-le")) // 2
        if units(r["x"]) <= 40:
            assert r["cut"] == r["x"]
        else:
            kept = r["cut"].removesuffix(text.TRUNCATED)
            assert r["x"].startswith(kept) and units(kept) in (39, 40) and r["cut"].endswith(text.TRUNCATED)


def test_stored_and_fresh_indexes_agree(spark, tmp_path):
    rng = random.Random(2)
    words = ["über", "uber", "Café", "cafe", "die", "der", "x1", "a_b"]
    rows = [(i, None if i == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(words)) for i in range(300)] + [(1000, "", None)]
    docs = spark.createDataFrame(rows, "id long, body string, title string").repartition(3)
    fresh = fts.Index.build(docs, "id", ["title", "body"])
    fresh.write(str(tmp_path / "i"), 5)
    stored = fts.Index.read(spark, str(tmp_path / "i"))
    for query in ("cafe", "uber die", "die_der", "uber_cafe der", "a_b", "nothing", "___", "x1 x1"):
        show = lambda index: sorted((r["doc_id"], round(r["score"], 9)) for r in index.scores(query).collect())  # noqa: E731, B023
        assert show(stored) == show(fresh)
    assert len(fts.Index.build(docs, "id", ["body"]).scores("cafe").collect()) > len(fts.Index.build(docs, "id", ["body"], fold=False).scores("cafe").collect())
    assert "bucket=" in "".join(stored._occurrences(["cafe"], 5).inputFiles())


def test_clusters_are_greedy_and_complete(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:03}", [float(x) for x in np.round(rng.normal(size=3), 1)]) for i in range(120)] + [("w0", []), ("w1", [0.0, 0.0, 0.0]), ("w2", [1.0])]
    found: dict[str, list] = {}
    for r in vectors.clusters(spark.createDataFrame(rows, "id string, vector array<double>").repartition(3), 0.9, 2, 4).orderBy("position").collect():
        found.setdefault(r["cluster_id"], []).append(r["id"])

    def alike(a, b):
        x, y = np.array(a), np.array(b)
        return len(x) == len(y) and np.linalg.norm(x) * np.linalg.norm(y) > 0 and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9

    taken, want = set(), []
    for i, (a, v) in enumerate(rows):
        if a in taken:
            continue
        members = [(a, v)]
        taken.add(a)
        for b, w in rows[i + 1 :]:
            if len(members) < 4 and b not in taken and all(alike(w, u) for _, u in members):
                members.append((b, w))
                taken.add(b)
        if len(members) > 1:
            want.append([m for m, _ in members])
    assert [found[f"cluster/{k}"] for k in range(1, len(found) + 1)] == want


def test_scanners_find_what_is_written(spark):
    script = '/** A */\nexport default class A extends B {\n  constructor() { if (x) { y(); } }\n  get z() { return "}"; } // }\n  /** runs */\n  static async run(a = {}) {\n    while (a) { go(b); }\n  }\n}\n/* no doc */\nvar C = class { q() {} };\nfunction* f(x) {\n}\nexport const E = Object.freeze({ a: 1 });\nlet open = function () {\n'
    found = [(s["name"], s["kind"], s["start_line"], s["end_line"], s["parent_class"], s["doc_comment"]) for s in extract.snapshot_symbols(script)]
    assert found == [
        ("A", "class", 2, 9, None, "/** A */"), ("z", "method", 4, 4, "A", None), ("run", "method", 6, 8, "A", "/** runs */"), ("C", "class", 11, 11, None, None), ("q", "method", 11, 11, "C", None),
        ("f", "function", 12, 13, None, None), ("E", "enum", 14, 14, None, None), ("open", "function", 15, 15, None, None),
    ]
    shader = "#version 300 es\n#define PI \\\n  3.14\nprecision highp float;\nuniform mat4 m[2];\n/* light */\nvec4 f(in vec3 n, float a) {\n  const float inner = 1.;\n  return g(n);\n}\nfloat proto(int);\nlayout(location=0) out vec4 o;\nout vec4 c;\nstruct S { vec3 p; } s;\nconst vec3 UP = vec3(0., 1., 0.);\nuniform Block { float x; };\nMat other(int a) {}\n"
    told = [(s["name"], s["type"], s["start_line"], s["end_line"], s["doc_comment"]) for s in extract.shader_symbols(shader, "a/Source/x.glsl")]
    assert told == [("PI", "define", 2, 2, None), ("m", "uniform", 5, 5, None), ("f", "function", 7, 10, "/* light */"), ("proto", "function", 11, 11, None), ("c", "varying", 13, 13, None), ("S", "struct", 14, 14, None), ("UP", "const", 15, 15, None)]
    for broken in ("", "{{{", "}", "class", "class A {", "/** open", "const x = "):
        extract.snapshot_symbols(broken), extract.shader_symbols(broken, "p"), extract.script_symbols(broken), extract.script_calls(broken)


def test_shaders_that_hold_a_question(spark):
    shaders = spark.createDataFrame([("1", "Light", "function", "f"), ("2", "skyLIGHT", "function", "f"), ("3", None, "function", "f"), ("4", "é", "function", "f")], "id string, name string, type string, file string")
    asked = spark.createDataFrame([(1, "light"), (2, "L"), (3, ""), (4, None), (5, "É"), (6, "lighthouse")], "query_id int, question string")
    found = evidence._names_holding(asked, shaders)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (5, "4")]


def test_trees_and_reviews(spark):
    drawn = graph.tree([("a", "b", "construct"), ("a", "b", "call"), ("a", "c", "static_call"), ("b", "a", "call")], "a", 3)
    assert drawn == "a\n├── b [new]\n│   └── a (circular)\n└── c [static]"
    empty = F.array().cast("array<string>")
    found = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("k").alias("canonical_id"), F.lit("pending").alias("status"), F.array(F.lit("x")).alias("draft_alias"), empty.alias("draft_symptoms"), empty.alias("draft_symbols"), F.lit(None).cast("string").alias("draft_category"), F.lit("p").alias("dup_of"), F.lit(True).alias("failed_draft"), F.lit(1).alias("source_count"), F.lit(1).alias("issue_count"), F.lit(0).alias("forum_count"), F.lit(0).alias("experience_count"), F.col("id").alias("created_at"))
    page = mining.review(found, spark.createDataFrame([], "id string, title string"), "pending", 2, 1)
    said = render.review_text(page, "pending", 1)
    assert said.startswith("pending: 2 to 3 of 3") and "(?) dup_of=p [failed]" in said and "(untitled) [k]" in said and "src=1(i=1/f=0/e=0)" in said
    assert "no rejected" in render.review_text(mining.review(found, found.select(F.col("id"), F.lit("").alias("title")), "rejected"), "rejected")


def test_drafts_are_asked_for_once(spark, tmp_path):
    class Counting:
        def complete(self, prompt):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            return '{"draftAlias": ["a"], "draftSymptoms": ["s"]}'

    issues = spark.createDataFrame([(i, "crash", "", ["bug"], "2024") for i in range(4)], "id long, title string, body string, labels array<string>, updated_at string")
    points = spark.createDataFrame([(f"issue:{i}", [1.0, float(i // 2) * 9]) for i in range(4)], "id string, vector array<double>")
    out = mining.run(issues, points, spark.createDataFrame([("p", [1.0])], "id string, vector array<double>"), Counting(), threshold=0.99)
    assert out["candidates"].count() == 2 and out["problems"].count() == 2 and len(out["candidates"].collect()) == 2
    assert (tmp_path / "calls").read_text() == "xx"


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from orrery.functions import folders

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folders.shared(Session())
