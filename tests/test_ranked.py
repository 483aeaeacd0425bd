"""The kept index: batched search with skipped blocks, and upkeep by segments, against a plain restatement."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.operators import fts, ranked

SCHEMA = "id long, title string, body string"
TERM = re.compile(r"[^\W_]+")


def plain(docs, questions, limit):
    """{question: [(id, score)]} by the ranking formula; docs: {id: (title, body)}."""
    lists = {i: [[t.lower() for t in TERM.findall(x or "")] for x in texts] for i, texts in docs.items()}
    mean = sum(len(a) + len(b) for a, b in lists.values()) / max(1, len(docs))
    out = {}
    for q, text in questions:
        words, scores = fts.query_phrases(text or ""), dict.fromkeys(docs, 0.0)
        for w in words:
            tf = {i: sum(c[k : k + len(w)] == w for c in cs for k in range(len(c))) for i, cs in lists.items()}
            df = sum(x > 0 for x in tf.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 0) or fts.LEAST_IDF
            scores = {i: s - idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * sum(map(len, lists[i])) / mean)) for i, s in scores.items() if tf[i]}
        if words:
            out[q] = [(round(s, 9), i) for s, i in sorted((s, i) for i, s in scores.items())[:limit]]
    return {q: v for q, v in out.items() if v}


def found(index, spark, questions, limit, **more):
    rows = index.search(spark.createDataFrame(questions, "query_id string, question string"), limit, **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(r["score"], 9), r["id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def texts(rng, n, first=0):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Eta", "theta"]
    some = lambda most: " ".join(rng.choices(words, [60, 30, 20, 10, 5, 3, 2, 1], k=rng.randrange(most)))
    return {first + i: (some(6), some(60)) for i in range(n)}


QUESTIONS = [("a", "alpha"), ("b", "alpha Theta"), ("c", "beta_gamma"), ("d", "beta_gamma alpha"), ("e", "alpha alpha"), ("f", "nothing"), ("g", "  ... "), ("h", None), ("i", "zeta eta theta")]


@pytest.fixture(scope="module")
def start():
    docs = texts(random.Random(3), 300)
    return docs | {900: (None, None), 901: ("", "alpha"), 902: ("", "alpha")}


def frame(spark, docs):
    return spark.createDataFrame([(i, *x) for i, x in docs.items()], SCHEMA).repartition(3)


def test_a_search_of_many_questions_equals_the_formula(spark, start, tmp_path):
    index = ranked.Index(spark, f"file://{tmp_path}/one", "id", ["title", "body"], block_documents=16)
    index.upsert(frame(spark, start))
    assert found(index, spark, QUESTIONS, 5) == plain(start, QUESTIONS, 5)
    assert found(index, spark, QUESTIONS, 1000) == plain(start, QUESTIONS, 1000)
    single = fts.search(fts.Index.build(frame(spark, start), "id", ["title", "body"]), frame(spark, start), "id", "alpha theta", 5)
    assert [(round(r["score"], 9), r["id"]) for r in single.collect()] == found(index, spark, [("b", "alpha Theta")], 5)["b"]
    report = {r["query_id"]: r for r in index.search(spark.createDataFrame(QUESTIONS, "query_id string, question string"), 3, report=True).collect()}
    assert report["a"]["blocks"] > 10 and report["a"]["first"] + report["a"]["later"] < report["a"]["blocks"]


def test_fresh_lists_answer_many_questions_too(spark, start):
    lists = fts.Index.build(frame(spark, start), "id", ["title", "body"])
    rows = fts.search_many(lists, spark.createDataFrame(QUESTIONS, "query_id string, question string"), 5).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(r["score"], 9), r["id"]))
    assert out == plain(start, QUESTIONS, 5)


def test_only_rows_that_meet_a_condition_are_ranked(spark, start, tmp_path):
    index = ranked.Index(spark, f"file://{tmp_path}/two", "id", ["title", "body"], block_documents=16)
    index.upsert(frame(spark, start))
    even = spark.createDataFrame([(i,) for i in start if i % 2 == 0], "id long")
    every = plain(start, QUESTIONS, 10_000)
    want = {q: [x for x in v if x[1] % 2 == 0][:4] for q, v in every.items()}
    assert found(index, spark, QUESTIONS, 4, condition=even) == {q: v for q, v in want.items() if v}


def test_an_index_that_is_kept_equals_a_fresh_one(spark, start, tmp_path):
    index, rng, docs = ranked.Index(spark, f"file://{tmp_path}/kept", "id", ["title", "body"], block_documents=16), random.Random(4), dict(start)
    assert found(index, spark, QUESTIONS, 5) == {}
    index.upsert(frame(spark, docs))
    files = lambda: {p.relative_to(tmp_path) for p in tmp_path.rglob("*.parquet")}
    for step in range(4):
        before, listed = index.state(), files()
        changed = texts(rng, 12, first=step * 20) | texts(rng, 5, first=1000 + 10 * step)
        docs |= changed
        now = index.upsert(frame(spark, changed | {None: ("alpha", "null key")}))
        assert listed <= files(), "what was written is never written again"
        assert now.documents == len(docs) and now.version > before.version
        gone = [step * 3, 5000, 1000 + 10 * step]
        docs = {i: x for i, x in docs.items() if i not in gone}
        index.delete(spark.createDataFrame([(i,) for i in (*gone, None)], "id long"))
        assert found(index, spark, QUESTIONS, 6) == plain(docs, QUESTIONS, 6), step
    assert len(index.state().segments) < ranked.MERGED + 2
    index.vacuum()
    assert found(index, spark, QUESTIONS, 6) == plain(docs, QUESTIONS, 6)
    index.delete(spark.createDataFrame([(i,) for i in docs], "id long"))
    assert found(index, spark, QUESTIONS, 6) == {}


def test_of_two_writers_from_one_version_one_fails(spark, tmp_path):
    index = ranked.Index(spark, f"file://{tmp_path}/race", "id", ["title", "body"])
    index.upsert(frame(spark, {1: ("a", "b")}))
    state = index.state()
    index.delete(spark.createDataFrame([(7,)], "id long"))
    with pytest.raises(Exception, match="exist"):
        index._publish(state)


def test_words_of_questions_are_those_of_single_searches(spark):
    texts = ["Alpha beta", "snake_case_word", "__", "é accent é", "x" * 50, "", None, "A1_b2 _c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fts.phrases("t").alias("p")).collect()
    assert [r["p"] for r in rows] == [fts.query_phrases(t or "") for t in texts]
    one = spark.createDataFrame([([(1, 1, 5), (2, 3, 9), (3, 2, 9), (4, 3, 12), (5, 1, 4)],)], "d array<struct<doc_id:long,tf:long,dl:long>>")
    assert [(p["tf"], p["dl"]) for p in one.select(ranked.peaks("d").alias("p")).first()["p"]] == [(1, 4), (3, 9)]
    assert one.where(F.size("d") == 0).count() == 0
