"""Phrases by automata, and patterns beyond what is sent to every executor, against plain restatements."""

from __future__ import annotations

import random

from orrery.operators import matching, phrases

PATTERN = "id string, name string, category string, aliases array<string>, triggerKeywords array<string>, symptoms array<string>, relatedSymbols array<string>, ordinal int"


def test_phrases_are_found_once_in_each_text(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))) for i in range(60)] + [(7, "ab"), (None, "ab"), (99, None), (98, ""), (97, "abab" * 20_000)]
    wanted = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    asked = spark.createDataFrame([(p,) for p in [*wanted, wanted[0], "", None]], "phrase string")
    want = sorted(((i, p) for i, t in texts if t is not None for p in wanted if p in t), key=str)
    docs = spark.createDataFrame(texts, "query_id long, text string").repartition(3)
    for size in (phrases.SHARD_BYTES, 40):
        assert sorted(map(tuple, phrases.held(docs, asked, shard_bytes=size).collect()), key=str) == want
    assert phrases.held(docs, asked.limit(0)).count() == 0


def test_many_patterns_match_as_few_do(spark):
    rng = random.Random(2)
    words = [a + b for a in "bcdfgklm" for b in ("ado", "eri", "ina", "olu", "usa")]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"p{i}", "n", rng.choice(words), [some(2) for _ in range(rng.randrange(3))] or None, [rng.choice(words) for _ in range(rng.randrange(2))], [some(4)] if i % 7 == 0 else [], [rng.choice(words)], i) for i in range(3000)]
    rows += [("e", "n", "", ["", " - "], ["two words", ""], [""], [], 9000), ("null", "n", None, None, None, None, None, 9001)]
    patterns = spark.createDataFrame(rows, PATTERN)
    asked = spark.createDataFrame([(i, some(rng.randrange(12))) for i in range(40)] + [(100, None), (101, ""), (102, "two words")], "query_id long, question string")
    told = lambda most: sorted((r["query_id"], r["id"], r["score"], tuple(r["matched"])) for r in matching.match_patterns(asked, patterns, most_bytes=most).collect())
    few = told(matching.KNOWLEDGE_BYTES)
    assert len(few) > 500 and told(0) == few
