"""Each registered query's operator against a brute-force version, on texts made to be awkward."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import decontaminate, katz, langid, lookup, ngram_join, scratch, sharding, spm, substring, tokens, topk, toxicity, warc

from . import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, __chunk string, kind string, held_out string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sentence(rng, n):
    return " ".join(rng.choice(["der", "the", "and", "of", "x", "Réel", "Ab", "cd9", "the.", "zu"]) + rng.choice(["", "", "", str(rng.randrange(50))]) for _ in range(n))


def awkward(seed=1):
    """Nulls, empty and very long texts, ties, repeats, near copies, shared passages."""
    rng = random.Random(seed)
    passage, long = sentence(rng, 60), sentence(rng, 30_000)
    texts = [None, "", "   \t\n", "one", "one", "two words", "Two  WORDS", "x" * 200_000, long, long + " tail", " é ", "a b c a b c a b c"]
    texts += [sentence(rng, rng.randrange(1, 200)) for _ in range(25)]
    texts += [sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 15) for _ in range(6)]
    base = sentence(rng, 150).split(" ")
    for _ in range(8):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [passage * 1, passage + " " + passage]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id " + passage), (None, None), (12, texts[12]), (12, texts[12]), (13, "another text of the same id")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ("de", None, None, "s", "h", "c", "k", "x", "y")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def got(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_words_and_hashes(rows):
    texts = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    for kind, lower, want in ((tokens.NON_SPACE, False, lambda t: brute.SPACED.findall(t or "")), (tokens.ALPHANUMERIC, True, brute.alnum_words)):
        words = tokens.split(data, offsets, kind, lower)
        raw = words.data.tobytes()
        found = [raw[a:b] for a, b in zip(words.start, words.end)]
        assert found == [w.encode() for _, t in rows for w in want(t)]
        hashes = words.hashes()
        assert len(set(found)) == len(set(hashes.tolist()))
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(found, hashes.tolist()))
        n = 3
        pairs = dict(zip(tokens.inside_text(words, n).tolist(), tokens.sequences(hashes, n)[tokens.inside_text(words, n)].tolist()))
        assert len({tuple(found[p : p + n]) for p in pairs}) == len(set(pairs.values()))


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lookup.unpack_sorted(lookup.pack_sorted(x), np.uint64) == x).all()
    for x in (np.zeros(0, int), np.array([1 << 40, 3]), np.arange(24).reshape(8, 3), np.array([[1, 1 << 33], [255, (1 << 62) + 5]])):
        y = lookup.unpack_counts(lookup.pack_counts(x))
        assert y.shape == x.shape and (y == x).all()
    x = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    parts = lookup.ranges(x, 7)
    assert [i for _, i, _ in parts] == [0, *[j for *_, j in parts[:-1]]] and parts[-1][2] == len(x)


def test_op1_katz(docs, rows, none):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = brute.Katz([t for i, t in rows if not brute.held_out(i, 7, 2)])
    found = got(katz.score(docs, held, chunk_bytes=100_000), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(((i, brute.held_out(i, 7, 2), len(model.tokens(t)), sum(w in model.words for w in model.tokens(t)), model.total, model.base_score(t), model.score(t)) for i, t in rows), key=str)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5:] for f in sorted(found, key=lambda x: (str(x[0]), x[2], x[6]))], [w[5:] for w in sorted(want, key=lambda x: (str(x[0]), x[2], x[6]))], rtol=1e-9)
    for u in ["<begin>", "the", "one", *list(model.words)[:20]]:
        assert abs(sum(model.probability(u, w) for w in model.words) + model.alpha.get(u, 1.0) * model.unseen - 1) < 1e-9
    assert got(katz.score(none, held), "doc_id") == []
    alone = got(katz.score(docs, F.lit(True)), "n_known", "train_tokens", "score")
    assert set(alone) == {(0, 0, 0.0)}


@pytest.mark.parametrize("least", [1, 2])
def test_op1_stored_tables(spark, docs, rows, tmp_path, least):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    path = str(tmp_path / "model")
    katz.write(docs, held, path, least=least, bucket_rows=5000)
    by_text = lambda found: sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in found.collect()), key=str)
    assert by_text(katz.evaluate(docs, path)) == by_text(katz.score(docs, held, order=3, least=least))
    kinds = spark.read.parquet(path).groupBy("kind").agg(F.countDistinct("bucket").alias("n")).collect()
    assert {r["kind"] for r in kinds} == {"word", "pair", "triple", "context", "pair_context", "unseen"} and max(r["n"] for r in kinds) > 1


def items(rows):
    w = brute.alnum_words(rows[20][1])
    return [(1, " ".join(w[:14])), (2, "Two, words!"), (3, "one"), (None, " ".join(w[3:20])), (5, None), (6, "..."), (7, "a b c a b c a b c a"), (1, "c a b")]


@pytest.mark.parametrize("size", [1 << 20, 30])
def test_op2_contamination(spark, docs, rows, none, size):
    table = spark.createDataFrame(items(rows), "item_id long, text string")
    found = got(decontaminate.report(docs, table, automaton_bytes=size), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(i, n, h, len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), h > 0) for i, n, h, s in brute.contamination(rows, items(rows))]
    assert found == sorted(want, key=str)
    assert got(decontaminate.report(none, table), "doc_id") == []
    assert {r[1] for r in got(decontaminate.report(docs, table.limit(0)), "doc_id", "n_hit")} == {0}


def test_op2_clean_leaves_no_window_and_clean_texts_alone(spark, docs, rows):
    table = spark.createDataFrame(items(rows), "item_id long, text string")
    left = decontaminate.clean(docs, table, most_coverage=0.9)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert all(h == 0 for _, _, h, _ in brute.contamination(kept, items(rows)))
    clean = sorted(((i, t) for (i, t), c in zip(rows, brute.contamination(rows, items(rows))) if c[2] == 0), key=str)
    assert [k for k in sorted(kept, key=str) if k in clean] == clean


PAGES = [(1, "http://a.b/c", "x" * 150), (2, "http://a.b/d", "x" * 150), (3, "u", "short"), (4, "u", "short"), (5, None, None), (6, "http://e", "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (7, "http://e", "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (None, "v", "y" * 300), (8, "w", "y" * 300), (9, "r", "z" * 500), (9, "r", "z" * 500), (10, "line\nbreak", "z" * 500), (11, "e", "")]


def test_op3_captures(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, type string")
    found = got(warc.report(pages, scratch.new_path(spark, "t")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min((j for j, _, g in PAGES if (g or "").encode() == b and j is not None), default=None)
        again = len(b) >= 100 and first is not None and first != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert found == sorted(want, key=str)
    assert got(warc.report(pages.limit(0), scratch.new_path(spark, "t")), "page_id") == []


def test_op3_records_survive_byte_for_byte(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch.new_path(spark, "t")
    warc.write(pages, path)
    nested = warc.assemble(warc.read(spark, path)).collect()
    assert len(nested) == len(PAGES)
    assert all(r["request"] is not None and r["metadata"] is not None for r in nested)
    assert sorted(bytes(r["main"]["payload"]) for r in nested if r["main"]["type"] == "response") == sorted((h or "").encode() for i, _, h in PAGES if i in (1, 3, 4, 5, 6, 8, 9, 11))


def test_op4_repeats(docs, rows, none):
    for window, size in ((35, 100_000), (5, 1 << 22), (35, 1 << 30)):
        found = got(substring.report(docs, window=window, chunk_bytes=size), "doc_id", "n_words", "n_removed", "kept_sha256")
        want = [(i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in brute.repeats(rows, window)]
        assert found == sorted(want, key=str)
    assert got(substring.report(none), "doc_id") == []


def test_op4_clean(docs, rows):
    left = substring.clean(docs, window=35)
    assert left.columns == docs.columns
    found = sorted(((r["doc_id"], brute.SPACED.findall(r["text"] or ""), r["text"] is None) for r in left.collect()), key=str)
    assert found == sorted(((i, k, t is None) for (i, t), (_, _, k) in zip(rows, brute.repeats(rows))), key=str)
    same = {(i, t) for (i, t), (_, n, k) in zip(rows, brute.repeats(rows)) if len(k) == n}
    assert same <= {(r["doc_id"], r["text"]) for r in left.collect()}


@pytest.mark.parametrize("period", list(substring.COVERS))
def test_difference_covers(period):
    cover = set(substring.COVERS[period])
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


PROBES = ["", " ", "a", "  a  b ", "héllo wörld\n\tx", "日本語 😀 \x00x", "▁a ▁▁ b", "<s> </s> <unk> <0x41>", "a" * 300, "\r\n", " x", "ﬁ Ⅷ", "a  b   c    d"]


def unigram_model(remove_extra):
    """A unigram model written by hand: a few pieces, byte fallback."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def piece(text, score, kind):
        raw = text.encode()
        body = b"\x0a" + varint(len(raw)) + raw + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(kind)
        return b"\x0a" + varint(len(body)) + body

    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)] + [piece(f"<0x{b:02X}>", -20, 6) for b in range(256)]
    pieces += [piece(t, s, 1) for t, s in (("▁", -2), ("▁a", -3), ("a", -3.5), ("b", -3.6), ("ab", -4), ("▁ab", -4.5), ("c", -5), ("▁the", -2.5), ("h", -6), ("e", -6.1), ("t", -6.2), ("aba", -4.2))]
    trainer = b"\x18\x01" + b"\x98\x02\x01"
    normal = b"\x18\x01" + b"\x20" + bytes([remove_extra]) + b"\x28\x01"
    return b"".join(pieces) + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normal)) + normal


@pytest.mark.parametrize("remove_extra", [0, 1])
def test_op5_unigram_parity(remove_extra):
    rng = random.Random(3)
    texts = PROBES + ["".join(rng.choice("aabbcthe  é") for _ in range(rng.randrange(60))) for _ in range(300)]
    model = unigram_model(remove_extra)
    assert spm.Model.parse(model).kind == spm.UNIGRAM
    assert spm.verify(model, texts) == []


def test_op5_parity_and_round_trip(docs, rows, none):
    with open(MODEL, "rb") as f:
        assert spm.verify(f.read(), PROBES + [t[:3000] for _, t in rows if t]) == []
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = got(spm.encode(docs, MODEL, key="doc_id", ids=False), "doc_id", "n_tokens", "ids_sha256", "round_trip")
    want = []
    for i, t in rows:
        ids = theirs.encode(t) if t is not None else None
        want.append((i, None, None, None) if t is None else (i, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), theirs.decode(ids) == t))
    assert found == sorted(want, key=str)
    assert got(spm.encode(none, MODEL), "doc_id") == []
    assert "token_ids" in spm.encode(docs, MODEL).columns


def test_op6_toxicity_fits_and_defaults(spark, docs, none):
    rng = random.Random(5)
    texts = []
    for i in range(1500):
        bad = i % 4 == 0
        w = sentence(rng, rng.randrange(5, 60)).split(" ")
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumble", "Blorg", "snarfing", "snarfed", "gr0mmet!"]))
        texts.append((i, " ".join(w), int(bad)))
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    scorer = toxicity.train(table.where("doc_id < 1200"), table.where("doc_id < 1200").select("doc_id", "toxic"))
    found = toxicity.score(table.where("doc_id >= 1200"), scorer).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, scorer).collect())
    assert toxicity.score(docs, scorer).count() == docs.count() and toxicity.score(none, scorer).count() == 0
    nothing = toxicity.train(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_op6_isotonic_and_features():
    x, y = toxicity.isotonic(np.array([1, 2, 3, 4, 4.0]), np.array([0, 1, 0, 1, 1.0]))
    assert list(np.interp([1, 2, 3, 4], x, y)) == [0, 0.5, 0.5, 1]
    empty = toxicity.features(np.zeros(0, np.uint8), np.array([0, 0]), toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
    assert empty.shape == (1, len(toxicity.NAMES)) and not empty.any()


@pytest.mark.parametrize(("size", "similarity", "tree"), [(3, (90, 100), 10**6), (3, (90, 100), 400), (5, (80, 100), 10**6), (2, (50, 100), 300)])
def test_op7_components(docs, rows, none, size, similarity, tree):
    found = got(ngram_join.components(docs, size=size, similarity=similarity, tree_ngrams=tree, chunk_bytes=100_000), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute.components(rows, size, *similarity), key=str)
    assert got(ngram_join.components(none), "doc_id") == []


def test_op7_tree_finds_what_all_pairs_do():
    rng = np.random.default_rng(2)
    for n, p, q in ((1, 9, 10), (60, 9, 10), (60, 5, 10), (40, 8, 10)):
        base = [np.unique(rng.integers(0, 1 << 62, 50, dtype=np.uint64)) for _ in range(4)]
        sets = [np.unique(np.concatenate([base[rng.integers(4)][: rng.integers(20, 50)], rng.integers(0, 1 << 62, rng.integers(1, 12), dtype=np.uint64)])) for _ in range(n)]
        want = ngram_join.Union(np.arange(n))
        for a in range(n):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                    want.join(a, b)
        found = ngram_join.Union(np.arange(n))
        for a, b in ngram_join.links(sets, p, q):
            found.join(a, b)
        assert (found.roots() == want.roots()).all()


def test_op8_top(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(400, 460)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, rows[0][1]), (550, []), (551, [1.0, 2.0]), (100, rows[100][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for shard in (37, 10_000):
        found = sorted(tuple(r) for r in topk.search(table, F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=4).select("query_id", "rank", "vec_id", "score").collect())
        assert found == brute.top(rows)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_op8_prunes_blocks_and_stays_exact_beyond_doubles():
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(32, dtype=np.int64) * 900, 64, axis=0) + rng.integers(0, 9, (2048, 32))
    ids = np.arange(2048)
    found, scores, blocks = topk.search_shard(ids, x, ids[:64], x[:64], 5)
    assert blocks <= 64 * len(x) // topk.BLOCK_ROWS / 4
    big = x * (1 << 24)
    again, exact, _ = topk.search_shard(ids, big, ids[:3], big[:3], 5)
    want = big[:3].astype(object) @ big.T.astype(object)
    for k in range(3):
        best = sorted((-s, j) for j, s in enumerate(want[k]) if j != k)[:5]
        assert [(j, -s) for s, j in best] == list(zip(again[k], exact[k]))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_op9_shards(spark, docs, rows, none, law):
    rng = random.Random(9)
    many = [(i, "hot " * 5 if i % 3 == 0 else sentence(rng, rng.randrange(1, 40))) for i in range(3000)]
    table = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    for frame, shards in ((table, 24), (docs, 5)):
        found = sharding.assign(frame, shards, law, bucket_rows=40).collect()
        assert len(found) == frame.count() and all(r["size"] == len((r["text"] or "").encode()) + 8 for r in found)
        slots = {}
        for r in found:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        if frame is table:
            sums = [sum(r["size"] if law == "bytes" else 1 for r in found if r["shard"] == k) for k in range(shards)]
            assert max(sums) - min(sums) <= (1 if law == "rows" else 2 * max(r["size"] for r in found))
    assert sharding.assign(none, 3, law).count() == 0


def test_op10_languages(spark, docs, none):
    rng = random.Random(11)
    words = {"aa": ["kala", "kalen", "okala", "ka"], "bb": ["zwirt", "zwo", "izwir", "zwurt"]}
    make = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(["", "s", "t"]) for _ in range(n))
    table = [(i, make(k := rng.choice("aa bb".split()), rng.randrange(3, 90)), k) for i in range(300)]
    chain = langid.train(spark.createDataFrame(table[:200] + [(999, "no label", None)], "doc_id long, text string, lang string"))
    found = langid.predict(spark.createDataFrame(table[200:], "doc_id long, text string, lang string"), chain).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98 and all(0 <= r["score"] <= 1 for r in found)
    mixed = spark.createDataFrame([(1, make("aa", 20) + " " + make("bb", 20))], "doc_id long, text string")
    spans = langid.predict(mixed, chain, spans=True).first()["lang_spans"]
    assert spans[0]["lang"] == "aa" and spans[-1]["lang"] == "bb" and sum(s["n_words"] for s in spans) == 40
    odd = {(r["text"], r["lang_pred"], r["score"]) for r in langid.predict(docs, chain).collect()}
    assert {(None, "und", 0.0), ("", "und", 0.0), ("   \t\n", "und", 0.0)} <= odd and len(odd) > 10
    assert langid.predict(none, chain).count() == 0
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_op10_lanes_are_exact(monkeypatch):
    rng = np.random.default_rng(0)
    chain = langid.Chain(list("abcd"), np.zeros((1, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), [])
    first = np.concatenate([[0], np.cumsum([1, 50, 7, 0, 8, 100, 13])])
    scores = rng.normal(size=(first[-1], 4))
    monkeypatch.setattr(langid, "LANE", 7)
    found = chain.posteriors(scores, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            w, step = np.exp(scores[a:b]), np.exp(chain.steps)
            forward, backward = [np.exp(chain.begin) * w[0]], [np.ones(4)]
            for t in range(1, b - a):
                forward.append((forward[-1] @ step) * w[t])
                backward.append(step @ (w[b - a - t] * backward[-1]))
            want = np.array(forward) * np.array(backward[::-1])
            assert np.allclose(found[a:b], want / want.sum(axis=1, keepdims=True))
