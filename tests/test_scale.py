"""What must not grow with the tables: what is sent to all executors, what a worker holds, what a task reads."""

from __future__ import annotations

import pandas as pd

from orrery.operators import extract


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


SCRIPT = "export class A# {\n  run() {\n    const b = new A#();\n    b.stop();\n  }\n  stop() {\n  }\n}\n"


def test_call_edges_send_no_table_to_all_executors(spark):
    files = spark.createDataFrame([(f"Source/A{i}.js", SCRIPT.replace("#", str(i))) for i in range(5)], "path string, content string")
    edges = extract.call_edges(files, extract.symbols(files))
    assert "Broadcast" not in _plan(edges)
    assert {(r["source_name"], r["target_name"], r["edge_type"]) for r in edges.collect()} == {(f"A{i}.run", t, k) for i in range(5) for t, k in ((f"A{i}", "construct"), (f"A{i}.stop", "call"))}
    assert {r["outcome"]: r["n"] for r in extract.call_stats(files, extract.symbols(files)).collect()} == {"form:new": 5, "form:member": 5, "edge:construct": 5, "edge:call": 5}


def test_scans_leave_a_worker_in_slices(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(extract, "_SLICE", 10)

    class Files:
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            taken.extend(run(iter([pd.DataFrame({"path": list("abc"), "content": ["x" * 11, "y" * 11, "z"]})])))

    extract._each(Files(), lambda c, p: [{"name": c[0]}], "path string, name string")
    assert [list(f.name) for f in taken] == [["x"], ["y"], ["z"]]


def test_sections_make_their_packs_once(spark):
    from pyspark.sql import functions as F

    from orrery.plans import catalog_packs

    made = spark.sparkContext.accumulator(0)

    def seen(k):
        made.add(1)
        return [str(k)]

    pack = spark.range(3).select(F.col("id").alias("query_id"), F.udf(seen, "array<string>").asNondeterministic()("id").alias("a")).withColumn("b", F.col("a"))
    rows = catalog_packs._sections(pack, a="", b="").collect()
    assert len(rows) == 6 and {r["n"] for r in rows} == {1} and made.value == 3


def test_related_symbols_deal_a_frequent_name_and_rank_only_repeated_ids(spark, monkeypatch):
    from orrery.operators import matching

    stored = []
    keep = matching.folders.stored
    monkeypatch.setattr(matching.folders, "stored", lambda frame, what: stored.append(what) or keep(frame, what))
    found = spark.createDataFrame([(q, 2.0, 0, ["B", "A"]) for q in range(200)], "query_id long, score double, ordinal int, relatedSymbols array<string>")
    symbols = spark.createDataFrame([(i, "A") for i in range(20)] + [(0, "B"), (99, "C")], "id long, name string")
    out = matching.related_symbols(found, symbols).collect()
    assert stored == ["named", "wanted"]
    assert len(out) == 200 * 20 and {r["name"] for r in out if r["id"] == 0} == {"B"}


def test_a_stored_index_exchanges_postings_once(spark):
    from orrery.operators import fts

    sized = fts.Index.build(spark.createDataFrame([(1, "b a b", "a"), (2, None, ""), (3, "", "c é")], "k long, x string, y string"), "k", ["x", "y"]).lists
    from pyspark.sql import functions as F

    rows = fts._postings(sized.withColumn("dl", (F.size("c0") + F.size("c1")).cast("long")), ["c0", "c1"])
    assert "Exchange" not in _plan(rows)
    got = {(r["doc_id"], r["term"], r["tf"], tuple((p["col"], p["pos"]) for p in r["places"]), r["dl"]) for r in rows.collect()}
    assert got == {(1, "a", 2, ((0, 1), (1, 0)), 4), (1, "b", 2, ((0, 0), (0, 2)), 4), (3, "c", 1, ((1, 0),), 2), (3, "e", 1, ((1, 1),), 2)}


def test_vectors_leave_a_worker_in_slices(spark, monkeypatch):
    from pyspark.sql import functions as F

    from orrery.operators import vectors

    sizes = []
    frame = spark.createDataFrame([("a b",)], "text string")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: sizes.extend(len(f) for f in run(iter([pd.DataFrame({"text": ["a b"] * 1201})]))))
    vectors.embed(frame, "text")
    assert sizes == [500, 500, 201]


def test_clusters_of_vectors_that_all_hang_together_are_formed_in_bounded_rounds(spark, monkeypatch):
    import numpy as np

    from orrery.operators import vectors

    for name, value in (("_REST", 3), ("_SEEDS", 16), ("_MEETING", 60), ("_TAKEN", 10)):
        monkeypatch.setattr(vectors, name, value)
    rounds = []
    form = vectors._forming
    monkeypatch.setattr(vectors, "_forming", lambda seeds, *rest: rounds.append(len(seeds)) or form(seeds, *rest))
    x = np.random.default_rng(5).normal(size=(120, 3))
    x[40:60] = x[40]
    ids = [f"k{i:03d}" for i in range(120)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [("k0505", [1.0])], "id string, vector array<double>").repartition(3)
    for least, most in ((2, None), (3, 4)):
        found = {}
        for r in vectors.clusters(frame, 0.5, least, most).orderBy("position").collect():
            found.setdefault(r["cluster_id"], []).append(r["id"])
        want = [[ids[i] for i in c] for c in vectors.greedy_clusters(list(x), 0.5, least, most)]
        assert [found[f"cluster/{k}"] for k in range(1, len(found) + 1)] == want
    assert len(rounds) > 8 and max(rounds) <= 16


def test_nearest_scores_pieces_and_ties_go_by_key(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from orrery.operators import vectors

    x = np.random.default_rng(2).normal(size=(90, 5)).astype(np.float32)
    x[50:60] = x[7]
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    x[70, 2] = np.inf
    want = {i: sorted((-(unit[i] * unit[j]).sum(), j) for j in range(90) if j not in (i, 70))[:4] for i in range(90) if i != 70}
    monkeypatch.setattr(vectors, "_PIECE", 8)
    taken = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **more: taken.append((a.shape, a.dtype)) or partition(a, *rest, **more))
    table = lambda name: pa.table({name: pa.array(range(90)), "v": pa.array([v.tolist() for v in x], pa.list_(pa.float32()))})
    rows = vectors._best(4, None)(table("id"), table("q")).to_pylist()
    assert {q: [(r["id"], round(r["score"], 12)) for r in rows if r["q"] == q] for q in want} == {q: [(j, round(-s, 12)) for s, j in found] for q, found in want.items()}
    assert len(taken) == 12 and {(a, d) for a, d in taken if a[0] == 8} == {((8, 8), np.dtype(np.float32))}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])], "id long, vector array<float>")
    found = vectors.nearest(frame.withColumnRenamed("id", "query_id"), frame, 4).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in found} == {(q, k, j) for q, hits in want.items() for k, (_, j) in enumerate(hits, 1)}


class _Says:
    def complete(self, prompt):
        return '{"intent": "refactor", "confidence": 0.7}'


def test_rules_are_worked_out_once_and_asked_on_all_cores(spark):
    from pyspark.sql import functions as F

    from orrery.operators import mining

    made = spark.sparkContext.accumulator(0)

    def seen(title):
        made.add(1)
        return title

    issues = spark.range(0, 8, 1, 1).select("id", F.udf(seen)(F.col("id").cast("string")).alias("title"), F.lit("").alias("body"), F.when(F.col("id") < 2, F.array(F.lit("bug"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    rows = mining.classify(issues, _Says()).collect()
    assert {r["id"]: (r["intent"], r["method"]) for r in rows} == {i: ("bug", "rule") if i < 2 else ("refactor", "llm") for i in range(8)} and made.value == 8


def test_searches_of_fresh_lists_exchange_only_terms_that_are_asked_for(spark, monkeypatch):
    from orrery.operators import fts

    kept = {}
    keep = fts.folders.stored
    monkeypatch.setattr(fts.folders, "stored", lambda frame, what: kept.setdefault(what, keep(frame, what)))
    docs = spark.createDataFrame([(1, "a b a b c", "a"), (2, None, "b a b a"), (3, "", "c é")], "k long, x string, y string")
    asked = spark.createDataFrame([(1, "a_b"), (2, "b"), (3, "a_b_a b"), (4, "")], "query_id long, question string")
    rows = fts.search_many(fts.Index.build(docs, "k", ["x", "y"]), asked, 5)
    assert {(r["term"], r["doc_id"], r["tf"]) for r in kept["held"].collect()} == {("a", 1, 3), ("b", 1, 2), ("a", 2, 2), ("b", 2, 2)}
    assert "Exchange" not in _plan(kept["held"])
    assert {(r["query_id"], r["id"]) for r in rows.collect()} == {(q, k) for q in (1, 2, 3) for k in (1, 2)}


def test_a_block_gives_back_the_best_documents_of_a_question_only(spark):
    import pyarrow as pa

    from orrery.operators import fts, ranked

    docs = list(range(40, 0, -1))
    rows = pa.table({
        "kind": [ranked._HOLDS, ranked._HOLDS, ranked._WENT], "unit": ["a", "b", None], "idf": [2.0, 1.0, None],
        "ids": pa.array([docs, docs[::2], [40, 2]]), "tfs": pa.array([[1 + d % 3 for d in docs], [1] * 20, None]), "dls": pa.array([[9] * 40, [9] * 20, None]),
    })
    part = lambda idf, tf: fts.part_of(idf, float(tf), 9.0, 7.0)
    asked = pa.table({"q": [7, 8, 9, 10], "words": pa.array([["a"], ["a", "b", "a"], ["a", "c"], ["b"]]), "least": pa.array([None, None, None, part(1.0, 1) * 2], pa.float64())})
    found = [(r["q"], r["doc_id"], r["score"]) for r in ranked._best_of_block(3, 7.0, False)(asked, rows).to_pylist()]
    want = {7: sorted((-part(2.0, 1 + d % 3), d) for d in docs if d not in (40, 2)), 8: sorted((-(part(2.0, 1 + d % 3) + part(1.0, 1) + part(2.0, 1 + d % 3)), d) for d in docs[::2] if d not in (40, 2))}
    assert found == [(q, d, s) for q in (7, 8) for s, d in want[q][:3]]


def test_a_segment_exchanges_documents_and_not_their_words(spark, tmp_path, monkeypatch):
    from orrery.operators import ranked

    exchanged = []
    kind = type(spark.range(1).groupBy("id"))
    run = kind.applyInArrow
    monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema: exchanged.append(self._df.count()) or run(self, f, schema))
    index = ranked.Index(spark, f"file://{tmp_path}/kept", "id", ["t"], block_documents=4)
    index.upsert(spark.createDataFrame([(i, "a b c a") for i in range(9)] + [(9, None), (9, "z")], "id long, t string"))
    assert exchanged[0] in (9, 10)
    rows = index._of("postings", list(index.state().segments)).withColumn("plain", ranked.peaks("documents")).collect()
    assert all(r["peaks"] == r["plain"] for r in rows)
    held = {(r["term"], d["doc_id"], d["tf"], d["dl"], tuple(p["pos"] for p in d["places"])) for r in rows for d in r["documents"]}
    assert {h for h in held if h[1] < 9} == {(t, i, n, 4, p) for i in range(9) for t, n, p in (("a", 2, (0, 3)), ("b", 1, (1,)), ("c", 1, (2,)))}
    assert all(r["n"] == len(r["documents"]) for r in rows)


def test_levels_of_stages_send_none_of_them_to_all_executors(spark, monkeypatch):
    from orrery.operators import graph

    plans = []
    keep = graph._kept
    monkeypatch.setattr(graph, "_kept", lambda frame: plans.append(_plan(frame)) or keep(frame))
    stages = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("z", ["gone"])], "id string, dependsOn array<string>")
    assert {(r["id"], r["level"]) for r in graph.topological_levels(stages).collect()} == {("a", 0), ("z", 0), ("b", 1), ("c", 2)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_the_last_step_of_a_search_gathers_no_frontier(spark, monkeypatch):
    from orrery.operators import graph

    kept = []
    keep = graph._kept
    monkeypatch.setattr(graph, "_kept", lambda frame: kept.append(frame.columns) or keep(frame))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("a", "b")], "s string, t string")
    rows = graph.search_many(edges, spark.createDataFrame([("a",), ("x",), (None,)], "id string"), 2, "s", "t")
    assert sorted((r["root"], r["s"], r["t"], r["depth"]) for r in rows.collect()) == [("a", "a", "b", 1), ("a", "a", "b", 1), ("a", "b", "c", 2), ("x", "b", "c", 2), ("x", "x", "b", 1)]
    assert sum("new" in c for c in kept) == 1


def test_questions_meet_the_automaton_and_their_patterns_with_tokens_worked_out_once(spark, monkeypatch):
    from orrery.operators import matching

    stored = []
    keep = matching.folders.stored
    monkeypatch.setattr(matching.folders, "stored", lambda frame, what: stored.append(what) or keep(frame, what))
    patterns = spark.createDataFrame([("p", "P", "c", ["b c"], ["a"], [], [], 0)], "id string, name string, category string, aliases array<string>, triggerKeywords array<string>, symptoms array<string>, relatedSymbols array<string>, ordinal int")
    asked = spark.createDataFrame([(1, "x bb cc"), (2, "aa"), (3, None)], "query_id long, question string")
    rows = [{(r["query_id"], r["id"], r["score"]) for r in matching.match_patterns(asked, patterns, most_bytes=n).collect()} for n in (0, 1 << 20)]
    assert rows[0] == rows[1] and stored == ["asked"]


def test_context_packs_send_no_table_to_all_executors(spark, monkeypatch):
    from orrery.functions import folders
    from orrery.operators import fts, graph
    from orrery.plans.engine import KnowledgeEngine

    symbols = spark.createDataFrame([(f"s{i}", f"name{i}" if i < 6 else f"name_{i}", "function", "f.js", 1, 2, None, [], [], None if i else "Owner") for i in range(9)], "id string, name string, kind string, file_path string, start_line int, end_line int, doc_comment string, exports array<string>, imports array<string>, parent_class string")
    edges = spark.createDataFrame([(f"s{i}", f"s{i * m}", "a", "b", "call", 1.0) for i in range(1, 9) for m in (2, 3) if i * m < 9], "source_id string, target_id string, source_name string, target_name string, edge_type string, weight double")
    source = spark.createDataFrame([(f"s{i}", f"name{i}", f"code {i}") for i in range(8)], "symbol_id string, name string, code string")
    issues = spark.createDataFrame([(k, k, f"name{k} x" if k < 6 else f"the name_{k}", "b", "open") for k in range(8)], "id long, number long, title string, body string, state string")
    tables = {"symbols": symbols, "call_edges": edges, "source_code": source, "issues": issues}
    names = spark.createDataFrame([("name1",), ("name_6",), ("Owner.name0",), ("NAME2",), ("nothing",), (None,)], "query string")

    def packs():
        engine, searched = KnowledgeEngine(spark, tables), []
        search = engine.search_many
        engine.search_many = lambda name, key, columns, questions, limit: searched.append((name, {r["question"] for r in questions.collect()})) or search(name, key, columns, questions, limit)
        found = {r["query_id"]: r.asDict(recursive=True) for r in engine.build_context_packs(names).collect()}
        return found, searched

    few, searched = packs()
    assert {q: [p["symbol"]["id"], [s["code"] for s in p["source"]], [(e["source_id"], e["target_id"]) for e in p["callgraph"]], [i["number"] for i in p["issues"]]] for q, p in few.items()} == {
        "name1": ["s1", ["code 1", "code 2", "code 3", "code 4"], [("s1", "s2"), ("s1", "s3"), ("s2", "s4"), ("s2", "s6"), ("s3", "s6")], [1]],
        "name_6": ["s6", ["code 6"], [], [6]], "Owner.name0": ["s0", ["code 0"], [], []],
        "NAME2": ["s2", ["code 2", "code 4", "code 6"], [("s2", "s4"), ("s2", "s6"), ("s4", "s8")], [2]],
    }
    # names that mean a symbol exactly are not searched for
    assert searched == [("symbols", {"NAME2", "nothing"}), ("issues", {"name1", "name_6", "Owner", "name2"})]
    plans = []
    stored, kept = folders.stored, graph._kept
    monkeypatch.setattr(folders, "stored", lambda frame, what: plans.append(_plan(frame)) or stored(frame, what))
    monkeypatch.setattr(graph, "_kept", lambda frame: plans.append(_plan(frame)) or kept(frame))
    monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(fts, "BROADCAST_TERMS", -1)
    assert packs()[0] == few
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_a_block_of_questions_meets_each_symbol_in_a_row(spark, monkeypatch):
    from orrery.operators import matching

    monkeypatch.setattr(matching, "_DEALS", 2)
    monkeypatch.setattr(matching, "_BLOCK", 25, raising=False)
    found = spark.createDataFrame([(q, 2.0, 0, ["A"]) for q in range(200)], "query_id long, score double, ordinal int, relatedSymbols array<string>")
    symbols = spark.createDataFrame([(i, "A", i % 3) for i in range(20)], "id long, name string, lines int")
    out = matching.related_symbols(found, symbols).collect()
    assert {(r["query_id"], r["id"], r["lines"]) for r in out} == {(q, i, i % 3) for q in range(200) for i in range(20)} and len(out) == 4000
    runs = {}
    for n, r in enumerate(out):
        if not n or out[n - 1]["id"] != r["id"]:
            run = []
            runs.setdefault(r["id"], []).append(run)
        run.append(r["query_id"])
    # questions of a block come in the same order for every symbol, and no block holds many
    assert all(sorted(r) == sorted(runs[0]) for r in runs.values()) and max(map(len, runs[0])) <= 60


def test_lines_of_names_that_no_pattern_has_are_not_exchanged(spark, tmp_path, monkeypatch):
    from orrery.plans import catalog_tools

    quantity = lambda k: 10 if k % 5 == 0 else 11
    orders = [(k // 8, k % 8, quantity(k)) for k in (*range(1, 9000), 2004, 2004, 2)]
    spark.createDataFrame(orders, "l_orderkey long, l_linenumber int, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "erst"), (2, "der die und le de")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    given = []
    meet = catalog_tools.matching.related_symbols
    monkeypatch.setattr(catalog_tools.matching, "related_symbols", lambda found, symbols: given.append(symbols) or meet(found, symbols))
    rows = sorted((r["query_id"], r["id"], r["code"]) for r in catalog_tools.pattern_symbols(spark, str(tmp_path)).collect())
    names = {1: "The", 2: "Der", 3: "La", 4: "Des"}
    asked = {1: {"The", "And"}, 2: {"Der", "Le", "Des"}}
    want = [(q, o * 8 + n, f"code {o * 8 + n}") for q, of in asked.items() for o, n, x in orders if names.get((o * 8 + n) % 2003) in of and x > 10]
    assert rows == sorted(want) and rows.count((1, 2004, "code 2004")) == 3
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning(id") == 1
