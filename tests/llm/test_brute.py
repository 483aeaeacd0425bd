"""Assignments, boosting and posteriors against plain restatements."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid, sharding, toxicity

from .test_contracts import sentence


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_op9_naive_assignment(spark, law):
    rng = random.Random(31)
    hot = sentence(rng, 30)
    rows = [(i, hot if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else sentence(rng, rng.randrange(1, 60))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.assign(docs, 7, law, tolerance=0)
    keyed = found.select("doc_id", "size", "shard", "slot", F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)).alias("a"), F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 60) - 1)).alias("b"))
    ordered = sorted(keyed.collect(), key=lambda r: (r["a"], r["b"]))
    weight = [r["size"] if law == "bytes" else 1 for r in ordered]
    below = [0, *itertools.accumulate(weight)]
    cuts = []
    for j in range(1, 7):
        target = below[-1] * j // 7
        k = max(i for i in range(len(ordered)) if below[i] <= target)
        cuts.append(k if 2 * (target - below[k]) <= weight[k] else k + 1)
    want = [sum(c <= i for c in cuts) for i in range(len(ordered))]
    assert [r["shard"] for r in ordered] == want
    assert [r["slot"] for r in ordered] == [i - ([0, *cuts][s]) for i, s in enumerate(want)]


def naive_boost(x, y, rounds, depth, rate, edges, least, ridge):
    share = min(max(sum(y) / len(y), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    margin = [base] * len(y)
    bins = [[sum(e <= v for e in edges[k]) for k, v in enumerate(row)] for row in x]
    width = max(map(len, edges)) + 1
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-9) for a in p]
        groups = {0: list(range(len(y)))}
        for _ in range(depth):
            then = {}
            for node, rows in groups.items():
                best, choice = None, (0, width)
                for f in range(len(edges)):
                    for cut in range(width - 1):
                        left = [i for i in rows if bins[i][f] <= cut]
                        right = [i for i in rows if bins[i][f] > cut]
                        gl, hl, gr, hr = (sum(v[i] for i in side) for side in (left, right) for v in (g, h))
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                        if hl < least * 0.05 or hr < least * 0.05:
                            gain = -1
                        if best is None or gain > best + 1e-12:
                            best, choice = gain, (f, cut)
                f, cut = choice if best > 1e-6 else (choice[0], width)
                then[2 * node] = [i for i in rows if bins[i][f] <= cut]
                then[2 * node + 1] = [i for i in rows if bins[i][f] > cut]
            groups = then
        for rows in groups.values():
            if rows:
                step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
                for i in rows:
                    margin[i] += step
    return margin


def test_op6_boosting_as_defined():
    rng = np.random.default_rng(8)
    x = np.round(rng.random((70, 4)) * 5, 1)
    x[:, 3] = 0
    y = ((x[:, 0] > 2.5) ^ (x[:, 1] > 3) | (rng.random(70) < 0.1)).astype(float)
    model = toxicity.boost(x, y, rounds=4, depth=2, bins=8)
    want = naive_boost(x.tolist(), y.tolist(), 4, 2, 0.2, [e.tolist() for e in model.edges], 5.0, 1.0)
    assert np.allclose(model.margins(x), want, rtol=1e-9)


def test_op6_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(9)
    score = np.round(rng.random(60), 1)
    y = (rng.random(60) < score).astype(float)
    xs, ys = toxicity.isotonic(score, y)
    fit = np.interp(score, xs, ys)
    values = sorted(set(score.tolist()))
    mean, count = ([float(f(y[score == v])) for v in values] for f in (np.mean, len))
    # the fit at a value is the greatest lower, least upper average (the minimax formula)
    avg = lambda i, j: sum(m * c for m, c in zip(mean[i : j + 1], count[i : j + 1])) / sum(count[i : j + 1])
    best = {v: max(min(avg(i, j) for j in range(k, len(values))) for i in range(k + 1)) for k, v in enumerate(values)}
    assert np.allclose(fit, [best[v] for v in score.tolist()])


def test_op10_posteriors_by_all_paths():
    rng = np.random.default_rng(10)
    chain = langid.Chain(list("abc"), np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), [])
    first = np.array([0, 1, 6, 6, 9])
    scores = rng.normal(size=(9, 3))
    found = chain.posteriors(scores, first)
    for a, b in zip(first[:-1], first[1:]):
        total, at = 0.0, np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            if not path:
                continue
            weight = math.exp(chain.begin[path[0]] + sum(scores[a + t, k] for t, k in enumerate(path)) + sum(chain.steps[i, j] for i, j in zip(path, path[1:])))
            total += weight
            for t, k in enumerate(path):
                at[t, k] += weight
        if b > a:
            assert np.allclose(found[a:b], at / total)


def test_op10_fits_what_its_samples_show(spark):
    """Pieces of a text of any length are drawn, and every language gets as many."""
    rng = random.Random(14)
    word = {"aa": "kalu", "bb": "zwirt", "cc": "ombre"}
    long = " ".join(word["aa"] + str(rng.randrange(1000)) for _ in range(50_000))
    rows = [(long, "aa"), *((" ".join(word[k] + rng.choice("xyz") for _ in range(30)), k) for k in ("bb", "cc") for _ in range(100)), (None, "aa"), ("no label", None), ("w" * 9000, "dd")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    drawn = langid._pieces(docs, "text", "lang", 400)
    count = {k: sum(x == k for _, x in drawn) for k in ("aa", "bb", "cc", "dd")}
    assert 80 <= count["aa"] <= 100 and 60 <= count["bb"] <= 100 and 60 <= count["cc"] <= 100 and count["dd"] == 2
    assert len({t for t, k in drawn if k == "aa"}) == count["aa"] and all(len(t.split()) <= 24 for t, _ in drawn)
    chain = langid.train(docs, pieces=400)
    assert langid.predict(spark.createDataFrame([("kalu kalu7",)], "text string"), chain).first()["lang_pred"] == "aa"


def test_op10_learns_languages_without_spaces(spark):
    """A language whose texts are single runs of characters is learnt and told like any other."""
    rng = random.Random(15)
    signs = [chr(0x4E00 + i) for i in range(300)]
    chinese = lambda n: "".join(rng.choice(signs) for _ in range(n))
    latin = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    german, english = ["der", "und", "nicht", "zwischen", "haben"], ["the", "and", "between", "having", "those"]
    rows = [x for _ in range(60) for x in ((chinese(3000), "zh"), (latin(german, 300), "de"), (latin(english, 300), "en"))]
    chain = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), pieces=3000)
    assert chain.languages == ["de", "en", "zh"]
    asked = [(chinese(500), "zh"), (chinese(5), "zh"), (latin(german, 40), "de"), (latin(english, 40), "en"), (chinese(200_000), "zh")]
    found = langid.predict(spark.createDataFrame(asked, "text string, want string"), chain, spans=True).collect()
    assert all(r["lang_pred"] == r["want"] and r["score"] > 0.7 for r in found)
    words = langid._split(np.frombuffer("字".encode() * 100 + b" abc " + b"x" * 130, np.uint8), np.array([0, 300, 435]))
    assert all(len(w) <= langid.WORD_BYTES + 3 and w.decode() for w in (words.data[a:b].tobytes() for a, b in zip(words.start, words.end)))
    assert b"".join(words.data[a:b].tobytes() for a, b in zip(words.start, words.end)) == ("字" * 100 + "abc" + "x" * 130).encode()
    assert words.first.tolist() == [0, 5, 9]


def test_op10_every_language_gets_its_share(spark):
    """Short words make many pieces of few bytes: they crowd no other language out."""
    rng = random.Random(16)
    short = [(" ".join(rng.choice("abcdefgh") + rng.choice("ijkl") for _ in range(4800)), "aa") for _ in range(40)]
    long = [(" ".join("wort" * 6 + str(rng.randrange(10**6)) for _ in range(24)), "bb") for _ in range(150)]
    docs = spark.createDataFrame(short + long, "text string, lang string").repartition(3)
    drawn = langid._pieces(docs, "text", "lang", 400)
    count = {k: sum(x == k for _, x in drawn) for k in ("aa", "bb")}
    assert count == {"aa": 200, "bb": 150}
