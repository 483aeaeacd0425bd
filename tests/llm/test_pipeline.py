"""The pipeline's stages on a small corpus, each against a brute-force version, and its queries' registration."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from orrery.llm import scratch

from . import brute
from .test_contracts import sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    item = sentence(rng, 24)
    passage = sentence(rng, 70)
    texts = [sentence(rng, rng.randrange(60, 200)) for _ in range(40)]
    copy = texts[3].split(" ")
    copy[50] = "changed"
    texts += [texts[0], texts[1], " ".join(copy), sentence(rng, 80) + " " + item + " " + sentence(rng, 40), item, None, "", "123 456", *(sentence(rng, 90) + "\n" + passage for _ in range(3))]
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", len(texts[4]))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = scratch.stored(stage(spark, docs, path), name)
        after = docs.collect()
        held[name] = after
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "language":
            assert {r["doc_id"] for r in after} == {i for i, t in before if t and any(c.isalpha() for c in t)}
        if name == "near_duplicates":
            want = {i for (i, n, c) in brute.components(before, 5, 80, 100) if i == c}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        if name == "repeated_passages":
            assert sorted((r["doc_id"], brute.SPACED.findall(r["text"])) for r in after) == sorted((i, k) for i, _, k in brute.repeats(before))
        if name == "benchmark_passages":
            assert all(h == 0 for _, _, h, _ in brute.contamination([(r["doc_id"], r["text"]) for r in after], [(1, item)]))
            clean = {i for i, _, h, _ in brute.contamination(before, [(1, item)]) if h == 0}
            assert clean <= {r["doc_id"] for r in after}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in held["pieces"])
    assert len(held["pieces"]) == len(held["benchmark_passages"])


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))] == list(range(1, 14)) and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", ["op2_suffix_automaton", "op4_difference_cover", "op7_signature_trees"])
def test_queries_over_a_folder(spark, folder, name):
    path, rows, _ = folder
    assert __spark_entry__.queries()[name](spark, path).count() == len(rows)
