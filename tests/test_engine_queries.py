"""Every issue query of the matched patterns is run, in the order of the patterns' ranks; callees and scores are not cut early."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans.engine import KnowledgeEngine
from orrery.sources import knowledge

QUESTION = "surface flicker in the scene"
ISSUES = "id long, number long, title string, body string, state string"


def test_diagnosis_runs_all_issue_queries(spark):
    queries = [f"query{k}" for k in range(30, 0, -1)]
    patterns = knowledge.patterns(spark).withColumn("issueQueries", F.array(*map(F.lit, [*queries, queries[3]])))
    issues = spark.createDataFrame([(k, k, f"query{k}", "b", "open") for k in range(1, 31)] + [(99, 99, "none of them", "b", "open")], ISSUES)
    engine = KnowledgeEngine(spark, {"issues": issues}, patterns)
    found = engine.diagnose_problem(QUESTION, budget=1_000_000).first()["related_issues"]
    assert [r["number"] for r in found] == list(range(30, 0, -1))


def test_many_packs_are_those_of_single_calls(spark, tmp_path):
    symbols = spark.createDataFrame([(f"s{i}", f"Name{i}", "function", "f.js", 1, 2, "doc", ["e"], ["i"], None if i else "Owner") for i in range(8)], "id string, name string, kind string, file_path string, start_line int, end_line int, doc_comment string, exports array<string>, imports array<string>, parent_class string")
    # the two nearest callees of s1 have no source: they use up no place
    edges = spark.createDataFrame([("s1", f"s{i}", "a", "b", "call", 1.0) for i in (2, 3, 4, 5)] + [("s5", "s6", "a", "b", "call", 1.0), ("s1", "s1", "a", "a", "call", 1.0)], "source_id string, target_id string, source_name string, target_name string, edge_type string, weight double")
    source = spark.createDataFrame([(f"s{i}", f"Name{i}", f"code {i}") for i in (1, 4, 5, 6, 7)], "symbol_id string, name string, code string")
    issues = spark.createDataFrame([(k, k, f"Name{k % 3} surface", "flicker", "open") for k in range(12)], ISSUES)
    tables = {"symbols": symbols, "call_edges": edges, "source_code": source, "issues": issues}
    engine, stored = KnowledgeEngine(spark, tables), KnowledgeEngine(spark, tables, index_root=f"file://{tmp_path}")
    assert [r["code"] for r in engine.build_context_pack("Name1").first()["source"]] == ["code 1", "code 4", "code 5", "code 6"]
    names = spark.createDataFrame([("Name1",), ("Name5",), ("Owner.Name0",), ("name2",), ("nothing",), (None,)], "query string")
    many = {r["query_id"]: r.asDict() for r in engine.build_context_packs(names).collect()}
    assert set(many) == {"Name1", "Name5", "Owner.Name0", "name2"} and many["name2"]["symbol"]["id"] == "s2"
    for name in ("Name1", "Owner.Name0"):
        assert many[name] == engine.build_context_pack(name).first().asDict() | {"query_id": name}
    asked = spark.createDataFrame([(1, QUESTION), (2, "nothing at all"), (3, None), (4, "z-fighting flicker")], "query_id long, question string")
    packs = {r["query_id"]: r.asDict() for r in engine.diagnose_many(asked).collect()}
    assert set(packs) == {1, 2, 3, 4} and packs[2]["matched_patterns"] == packs[3]["matched_patterns"] == []
    assert packs[1] == engine.diagnose_problem(QUESTION).first().asDict() | {"query_id": 1}
    assert packs == {r["query_id"]: r.asDict() for r in stored.diagnose_many(asked).collect()}


def test_hybrid_scores_are_those_of_all_patterns(spark):
    points = spark.createDataFrame([(f"pattern:{i:05d}", f"pattern:{i:05d}", "pattern", [1.0, float(i)]) for i in range(1200)] + [("x", "x", "stage", [1.0, 0.0])], "id string, node_id string, type string, vector array<double>")
    engine = KnowledgeEngine(spark, {"vectors": points}, encoder=lambda texts: [[1.0, 0.0] for _ in texts])
    one = {r["id"]: round(r["vector_score"], 9) for r in engine.vector_scores("anything").collect()}
    assert len(one) == 1200 and min(one, key=one.get) == "01199"
    asked = spark.createDataFrame([("a", "anything"), ("b", None)], "query_id string, question string")
    many = engine.vector_scores_of(asked).collect()
    assert {(r["query_id"], r["id"]): round(r["vector_score"], 9) for r in many} == {(q, i): s for q in "ab" for i, s in one.items()}


def test_questions_with_the_same_patterns_share_a_pack_but_not_its_scores(spark, monkeypatch):
    from orrery.plans import batch

    rows = {}
    keep = batch.folders.stored

    def counted(frame, what):
        out = keep(frame, what)
        rows[what] = out.count()
        return out

    monkeypatch.setattr(batch.folders, "stored", counted)
    monkeypatch.setattr(batch, "MEMBERS", 2, raising=False)
    texts = "array<string>"
    patterns = spark.createDataFrame(
        [("p1", "one", "c1", ["red sun"], ["sun"], [], ["A", "B"], ["c"], ["sun"], ["st"], ["look"], ["fix 1"], 0), ("p2", "two", "c2", ["blue moon"], ["moon"], [], ["B", "A"], [], ["moon"], [], ["look", "wait"], [], 1)],
        f"id string, name string, category string, aliases {texts}, triggerKeywords {texts}, symptoms {texts}, relatedSymbols {texts}, possibleCauses {texts}, issueQueries {texts}, relatedStages {texts}, investigationSteps {texts}, fixSuggestions {texts}, ordinal int",
    )
    symbols = spark.createDataFrame([(f"{n}{i}", n, "function", "f.js") for n in "AB" for i in range(3)], "id string, name string, kind string, file_path string")
    source = spark.createDataFrame([("A1", "A", "code"), ("B2", "B", "code")], "symbol_id string, name string, code string")
    edges = spark.createDataFrame([("A0", "B0", "call")], "source_id string, target_id string, edge_type string")
    nodes = spark.createDataFrame([("e1", "tide", "tide and sand", "issue"), ("e2", "tide", "tide, tide and more", "issue")], "id string, title string, summary string, type string")
    engine = KnowledgeEngine(spark, {"symbols": symbols, "source_code": source, "call_edges": edges, "experience_node": nodes}, patterns)
    said = ["sun", "red sun", "moon", "blue moon and sun", "red sun and moon", "tide", "nothing", None]
    asked = spark.createDataFrame([(i, said[i % 8]) for i in range(48)], "query_id long, question string")
    got = {r["query_id"]: r.asDict(recursive=True) for r in engine.diagnose_many(asked).collect()}
    assert set(got) == set(range(48)) and rows["symbols"] == 4 * 6  # once for each of the four lists of patterns, not for each of 30 questions
    score = {"sun": {"p1": 2.0}, "red sun": {"p1": 5.0}, "moon": {"p2": 2.0}, "blue moon and sun": {"p2": 5.0, "p1": 2.0}, "red sun and moon": {"p1": 5.0, "p2": 2.0}}
    for i, pack in got.items():
        want = score.get(said[i % 8], {})
        assert pack["question"] == said[i % 8] and {m["id"]: m["score"] for m in pack["matched_patterns"]} == want and list(want) == [m["id"] for m in pack["matched_patterns"]]
        assert [m["s"] for m in pack["matched_patterns"]] == [-s for s in want.values()] and all(m["matched"] for m in pack["matched_patterns"])
        first = next(iter(want), None)  # names both symbols, so all are where it names them
        names = {"p1": "AB", "p2": "BA"}.get(first, "")
        assert [(s["at"]["o"]["s"], s["at"]["o"]["ordinal"], s["at"]["n"], s["id"]) for s in pack["related_symbols"]] == [(-want[first], int(first == "p2"), n, f"{x}{k}") for n, x in enumerate(names) for k in range(3)]
        assert [(s["at"]["o"]["s"], s["id"]) for s in pack["related_source"]] == [(-want[first], {"A": "A1", "B": "B2"}[x]) for x in names]
        assert pack["investigation_steps"] == (["look", "wait"] if "p2" in want else ["look"] if want else [])
        assert [(e["id"], e["score"] < 0) for e in pack["related_experiences"]] == ([("e2", True), ("e1", True)] if said[i % 8] == "tide" else []) and len(pack["callgraph"]) == bool(want)
    cut = {r["query_id"]: r for r in engine.diagnose_many(asked, budget=60).collect()}
    assert cut[5]["related_experiences"] and not cut[1]["related_source"] and cut[1]["truncated"] and cut[1]["matched_patterns"][0]["score"] == 5.0
    packs, members = engine.diagnose_shared(asked)
    assert packs.count() == 6 and members.count() == 48  # four lists of patterns, one of experiences, and none of either
