"""Byte-level BPE, vector codes and source divergence against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orrery.llm import byte_bpe, divergence, queries, tokens, vector_codes

from .test_contracts import awkward

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
DOCUMENTS = "doc_id long, text string, lang string, source string, n_tokens string, ids_sha256 int, term string, n string, part string"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def theirs(vocabulary):
    return tiktoken.Encoding("theirs", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def joined(encoder, text):
    return [i for ids, _ in encoder.encode(text) for i in ids.tolist()]


# --- byte-level BPE ---


def test_op11_whole_result_is_that_of_tiktoken(spark, theirs):
    rows = awkward(5) + [(500, "naïve 中文 👩‍👩‍👧 \x1c\x85 I'll 'tis ՘ \U0003fc3b\U00012475 x́"), (501, "ß" * 300_000), (502, "ab" * 5000)]
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], DOCUMENTS).repartition(3)
    found = byte_bpe.encode(docs, PATH, PATTERN, key="doc_id", ids=False)
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    whole = byte_bpe.encode(docs, PATH, PATTERN)
    assert whole.columns == ["doc_id", "text", "lang", "source", "term", "n", "part", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    back = byte_bpe.decode(whole.withColumn("token_ids", F.when(F.col("doc_id") != 500, F.col("token_ids"))), PATH)
    assert all(r["decoded"] == ((r["text"] or "").encode() if r["doc_id"] not in (None, 500) else None) for r in back.collect())
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN, key="doc_id").count() == 0


def test_op11_random_strings_and_places_to_go_back(vocabulary, theirs):
    encoder, rng = byte_bpe.Encoder(vocabulary), random.Random(2)
    parts = ["a", "ing", " the", "  ", "\n", "é", "中", "👍", "1", "'s", "'re", "!?", "\x1c", "՘", "\U0003fc3b", "\U00012475", "x", "ed", "tion", " "]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert joined(encoder, text) == theirs.encode_ordinary(text)
    for letters in ("ab", "aeiourst", "xyz01"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert joined(encoder, text) == theirs.encode_ordinary(text)


def test_op11_segments_change_nothing(vocabulary, theirs, monkeypatch):
    encoder, rng = byte_bpe.Encoder(vocabulary), random.Random(3)
    monkeypatch.setattr(byte_bpe, "_SEGMENT", 50)
    monkeypatch.setattr(byte_bpe, "_MOST_PIECES", 20)
    monkeypatch.setattr(byte_bpe, "_MOST_PAIRS", 20)
    text = "".join(rng.choice(["word", " word", "  ", " 9", "'s", "\n", " é"]) for _ in range(2000))
    assert len(list(encoder.segments(text))) > 10 and joined(encoder, text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(8))
def test_op11_any_file_of_ranks(seed):
    """Ranks of made-up merges: in order, out of order, and with tokens that merging never gives."""
    rng = random.Random(seed)
    made = [bytes([i]) for i in range(256)]
    few = [b"a", b"b", b"c"]
    for _ in range(40):
        x = rng.choice(few) + rng.choice(few)
        if x not in made and len(x) < 9:
            few.append(x)
            made.append(x)
    if seed % 2:
        made += [b"abcabcabca", b"ccccccccccc"]
    if seed % 4 >= 2:
        rest = made[256:]
        rng.shuffle(rest)
        made = made[:256] + rest
    vocabulary = byte_bpe.Vocabulary.of({x: i for i, x in enumerate(made)}, r"[abc]+|[^abc]+")
    encoder, theirs = byte_bpe.Encoder(vocabulary), tiktoken.Encoding("x", pat_str=r"[abc]+|[^abc]+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    for _ in range(1500):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        assert joined(encoder, text) == theirs.encode_ordinary(text), (seed, text)


def test_op11_wrong_input(tmp_path, vocabulary):
    (tmp_path / "few").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="255 single bytes"):
        byte_bpe.Vocabulary.load(str(tmp_path / "few"), PATTERN)
    with pytest.raises(ValueError, match="no token has"):
        byte_bpe.Encoder(vocabulary).decode(np.array([60_000]))


# --- vector codes ---


def brute_codes(rows, parts, entries, rounds, scale):
    """(key, code, error, label error) and the entries, in plain integers."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    whole = [([int(np.floor(float(c) * scale)) for c in v] + [0] * width)[:width] for _, v, _ in kept]
    step = width // parts
    cut = [[w[p * step : (p + 1) * step] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [int(np.floor(float(c) * scale)) for c in kept[k][1]]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, found, errors)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_op12_equals_plain_integers(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.uniform(-1, 1), rng.choice([0.0, 0.5, -0.5, 0.25])])
    width = (8, 6, 12)[seed]
    rows = [(i, [value() for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for i in range(120)]
    rows += rows[:5] + [(7, [0.125] * width, 9), (None, [0.5] * width, 1), (None, [0.25] * width, None), (200, None, 1), (201, [float("nan")] + [0.0] * (width - 1), 1), (202, [None] + [0.0] * (width - 1), 1), (203, [float("inf")] * width, 1), (204, [0.5] * (width - 3), 2), (205, [], 2)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, error string").repartition(3)
    found = vector_codes.report(table, parts=4, entries=16, rounds=3, scale=64)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, 4, 16, 3, 64)


def test_op12_trees_find_the_lowest_of_the_nearest():
    rng = np.random.default_rng(1)
    for spread, n in ((2, 256), (50, 256), (1 << 27, 100), (3, 1), (0, 40)):
        entries, points = rng.integers(-spread, spread + 1, (n, 5)), rng.integers(-spread, spread + 1, (500, 5))
        far = (((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)).astype(float)
        for leaf in (1, 16):
            entry, distance = vector_codes.KdTree.of(entries, leaf).nearest(points)
            assert entry.tolist() == far.argmin(axis=1).tolist() and distance.astype(float).tolist() == far.min(axis=1).tolist()
    assert [x.tolist() for x in vector_codes.KdTree.of(np.zeros((3, 0), int)).nearest(np.zeros((2, 0), int))] == [[0, 0], [0, 0]]
    with pytest.raises(ValueError, match="62 bits"):
        vector_codes.KdTree.of(np.full((2, 4), 1 << 30)).nearest(np.zeros((1, 4), int))


def test_op12_empty_tables_and_decoding(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.report(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.report(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = spark.createDataFrame([(i, [float(i)] * 8, 0) for i in range(4)], schema)
    books = vector_codes.train(rows, entries=4, scale=16)
    codes = vector_codes.encode(rows, books, "vec_id").collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in codes) == [(i, f"{i:02x}" * 4, 0) for i in range(4)]
    back = vector_codes.decode(spark.createDataFrame([(r["code"],) for r in codes] + [(None,)], "code string"), books)
    assert {r["code"]: r["decoded"] for r in back.collect()} == {None: None} | {f"{i:02x}" * 4: [float(i)] * 8 for i in range(4)}
    with pytest.raises(Exception, match="must be below"):
        vector_codes.train(spark.createDataFrame([(1, [1e9] * 8, 0)], schema))


# --- source divergence ---


def brute_divergence(rows, least, ranks, unit=1_000_000_000, add=5):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = word.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in documents[lang].items() if d >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + unit * (c + add) // (n + add * len(kept))  # noqa: B023, E731
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        for a in sources:
            pairs = [(sum(abs(share(counts[lang, a][t], total[a]) - share(counts[lang, b][t], total[b])) for t in kept), b) for b in sources if b != a]
            more = [(share(counts[lang, a][t], total[a]) - share(whole[t], sum(total.values())), t) for t in kept if counts[lang, a][t]]
            for part, found, most in (("pair", pairs, None), ("term", [x for x in more if x[0] > 0], ranks)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, a, part, item, v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def source_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "und", "élan", "中文", "x1y", "a-b", "zz", "w" * 300, "rare"]
    rows = []
    for _ in range(300):
        source = rng.choice(["s1"] * 6 + ["s2", "s3", "s4", None])
        weights = [5, 3, 4, 2, 1, 1, 1, 1, 1, 0.2] if source == "s1" else [1, 1, 1, 4, 3, 2, 2, 1, 1, 0.2]
        rows.append((" ".join(rng.choices(vocabulary, weights, k=rng.randrange(30))), rng.choice(["de", "de", "en", None]), source))
    return rows + [(None, "de", "s9"), ("", "fr", "only"), ("nothing kept", "it", "p"), ("nothing kept", "it", "q"), (None, None, None)] + [("the " * 5000 + "中", "de", "s2")] + [rows[0]] * 3


@pytest.mark.parametrize("seed", range(2))
def test_op13_equals_the_dense_sums(spark, seed):
    rows = source_rows(seed)
    docs = spark.createDataFrame([(i, *r, *["x"] * 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n string, value string, rank string, z string").repartition(5)
    found = divergence.audit(docs, least_documents=8, ranks=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 8, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_op13_blocks_and_steps_change_nothing(spark, monkeypatch):
    rows = source_rows(7)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    for name, value in (("_BLOCK", 2), ("_SALT", 3), ("_STEP", 6), ("_DENSE", 0), ("_SLICE_BYTES", 500)):
        monkeypatch.setattr(divergence, name, value)
    # workers import the package afresh, so the parts that read these bounds are also called here
    assert sorted(map(tuple, divergence.audit(docs, 8, 50).collect())) == brute_divergence(rows, 8, 50)
    import pyarrow as pa

    posted = [{"lang": "x", "postings": [{"source": s, "p": 10 * i + len(s), "z": i + 1} for i, s in enumerate(own)]} for own in (["a", "b", "c"], ["a"], ["b", "d", "a", "c"], ["a", "b", "c"])]
    batch = pa.RecordBatch.from_pylist(posted)
    small = pa.concat_tables([pa.Table.from_batches([b]) for b in divergence._shared([batch])]).group_by(["lang", "a", "b"]).aggregate([("value", "sum")]).to_pylist()
    monkeypatch.undo()
    large = pa.Table.from_batches(list(divergence._shared([batch]))).to_pylist()
    nonzero = lambda rows, name: sorted((r["a"], r["b"], r[name]) for r in rows if r[name])
    assert nonzero(small, "value_sum") == nonzero(large, "value")


def test_op13_words_are_letters(spark):
    rows = [("Ab1cd_é-ß\x7f中X", "l", "s")]
    found = divergence.counted(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(r["term"] for r in found) == sorted(["ab", "cd", "é", "ß", "中x"])
    assert tokens.LOWER[0x41] == 0x61
