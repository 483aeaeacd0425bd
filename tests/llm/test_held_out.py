"""The classifiers' whole queries on rows that they haven't learnt from."""

from __future__ import annotations

import os
import zlib

import pytest

from orrery.llm import queries

FOLDER, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the driver's tables are not here")


def held(doc_id, divisor, remainder):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


def test_op10_tells_languages_it_has_not_seen(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op10_language_chain(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in found)
    learnt = {d["lang"] for i, d in docs.items() if not held(i, 4, 2) and d["lang"]}
    assert {r["lang_pred"] for r in found} <= learnt | {"und"}
    judged = [r for r in found if r["held_out"] and docs[r["doc_id"]]["lang"] and len((docs[r["doc_id"]]["text"] or "").split()) >= 5]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged)
    assert len(judged) > 100 and right >= 0.9 * len(judged)


def test_op6_ranks_toxic_documents_it_has_not_seen(spark):
    """On the larger tables: the smaller ones have some forty labelled toxic rows, which are too few to learn from."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    found = queries.op6_toxicity_trees(spark, LARGER).collect()
    assert len(found) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    toxic = [r["score"] for r in found if r["held_out"] and labels.get(r["doc_id"]) == 1]
    clean = [r["score"] for r in found if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert toxic and clean
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.9
