"""What a review found to be less than the whole job."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import decontaminate, katz, ngram_join, queries

from . import brute
from .test_contracts import awkward, sentence


class Katz3(brute.Katz):
    """A trigram model straight from the definition."""

    def __init__(self, texts, k=5, least=1):
        super().__init__(texts, k, least)
        triples, self.pair_events = Counter(), Counter()
        for t in texts:
            w = ["<begin>", *self.tokens(t)]
            triples.update(zip(w, w[1:], w[2:]))
            self.pair_events.update(zip(w, w[1:-1]))
        self.d3 = brute._discounts(triples.values(), k, least)
        self.triples = {x: c for x, c in triples.items() if c >= least}
        follow = defaultdict(list)
        for (v, u, w), c in self.triples.items():
            follow[v, u].append((w, c))
        self.base3, self.alpha3 = {}, {}
        for x, n in self.pair_events.items():
            rest = n - math.fsum(self.d3(c) * c for _, c in follow[x])
            more = rest <= 1e-9 * n
            self.base3[x] = n + more
            self.alpha3[x] = (1 if more else rest) / self.base3[x] / (1 - math.fsum(self.probability(x[1], w) for w, _ in follow[x]))

    def third(self, v, u, w):
        if (v, u, w) in self.triples:
            return self.d3(self.triples[v, u, w]) * self.triples[v, u, w] / self.base3[v, u]
        return self.alpha3.get((v, u), 1.0) * self.probability(u, w)

    def score(self, text):
        w = ["<begin>", *self.tokens(text)]
        return math.log10(self.probability(w[0], w[1])) + sum(math.log10(self.third(*x)) for x in zip(w, w[1:], w[2:]))


def test_op1_keeps_singletons_and_triples(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    rows += awkward() + [(i, sentence(rng, 80)) for i in range(400, 440)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = Katz3([t for i, t in rows if not brute.held_out(i, 7, 2)])
    for v, u in list(model.pair_events)[:60]:
        assert abs(sum(model.third(v, u, w) for w in model.words) + model.alpha3[v, u] * model.alpha.get(u, 1.0) * model.unseen - 1) < 1e-9
    want = sorted(((str(i), model.score(t)) for i, t in rows))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op1_katz_backoff(spark, str(tmp_path)), katz.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, chunk_bytes=20_000, order=3, least=1)):
        found = sorted((str(r["doc_id"]), r["score"]) for r in found.collect())
        assert [f[0] for f in found] == [w[0] for w in want]
        assert np.allclose([f[1] for f in found], [w[1] for w in want], rtol=1e-9)


@pytest.mark.parametrize("tree", [10**6, 400])
def test_op7_counts_every_link(spark, tree):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    grams = []
    for _, t in rows:
        w = brute.SPACED.findall((t or "").translate(brute.LOWER))
        grams.append({tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set())
    near = lambda a, b: a and b and 10 * len(a & b) >= 9 * len(a | b)
    want = sorted((str(i), sum(bool(near(a, b)) for k, b in enumerate(grams) if k != n)) for n, ((i, _), a) in enumerate(zip(rows, grams)))
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in ngram_join.joined(docs, tree_ngrams=tree, chunk_bytes=100_000).collect()) == want
    assert max(n for _, n in want) > 4


def test_pipeline_near_duplicates_go_by_row(spark):
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (6, c), (6, d), (7, c), (7, c), (8, d + " more"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (5, b), (6, c), (6, d), (8, ""), (8, "")])
    null = spark.createDataFrame([(None, a, 1), (None, a, 2), (3, a, 3), (None, b, 4)], docs.schema)
    assert sorted(r["n_chars"] for r in corpus_pipeline.near_duplicates(spark, null, "").collect()) == [3, 4]


def test_pipeline_language_keeps_mixed_documents(spark):
    rng = random.Random(12)
    words = {"aa": ["kala", "kalen", "okala", "ka"], "bb": ["zwirt", "zwo", "izwir", "zwurt"], "cc": ["mimo", "momi", "umimo", "mom"]}
    make = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(["", "s", "t"]) for _ in range(n))
    rows = [(i, make(k := rng.choice(sorted(words)), rng.randrange(20, 90)), k) for i in range(300)]
    rows += [(1001, make("aa", 30) + " " + make("bb", 30), None), (1002, " ".join(make(k, 30) for k in words), None), (1003, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {1001, 1002} <= kept and 1003 not in kept


def test_pipeline_cuts_windows_of_every_automaton(spark):
    x, y = ([f"{c}{k}" for k in range(12)] for c in "xy")
    filler = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, " ".join([filler("a"), *x[:6], *y, *x[6:], filler("b")])), (2, " ".join([filler("c"), *y[:6], *x, *y[6:], filler("d")])), (3, filler("e"))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, " ".join(x)), (2, " ".join(y))]
    for size in (30, 1 << 20):
        kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"), automaton_bytes=size).collect()
        assert sorted(r["doc_id"] for r in kept) == [1, 2, 3]
        assert all(h == 0 for _, _, h, _ in brute.contamination([(r["doc_id"], r["text"]) for r in kept], items))


@pytest.mark.parametrize(("p", "q"), [(90, 100), (80, 100), (100, 100)])
def test_op7_links_at_the_limit_across_bands_of_sizes(spark, p, q):
    words = [f"w{i}" for i in range(260)]
    rows = [(n, " ".join(words[:n])) for n in [*range(3, 60), *(9 * k + 2 for k in range(7, 28)), *(10 * k + 2 for k in range(6, 26))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.joined(docs, similarity=(p, q), tree_ngrams=150, chunk_bytes=2000).collect()}
    size = Counter(n - 2 for n, _ in rows)
    links = {n: sum(c for m, c in size.items() if q * min(m, n - 2) >= p * max(m, n - 2)) - 1 for n, _ in rows}
    want = {(i, s, c, links[i]) for i, s, c in brute.components(rows, 3, p, q)}
    assert found == want


def test_repeated_rows_are_dealt_over_chunks(spark):
    from orrery.llm import lookup

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words here").alias("text"))
    parts, total = lookup.dealt(docs, "doc_id", "text", 3000)
    sizes = [r["count"] for r in parts.groupBy("__chunk").count().collect()]
    assert total == 60_000 and len(sizes) == 20 and max(sizes) < 300


def test_op5_long_texts_in_segments_and_parity(spark):
    from orrery.llm import spm

    from .test_contracts import MODEL

    rng = random.Random(13)
    long = sentence(rng, 60_000)
    texts = [long, "a" * 400_000, " " + long[:300_000] + "  é \n" + long[:9], *(sentence(rng, 40) for _ in range(200)), None, ""]
    worker = spm._Worker(open(MODEL, "rb").read(), 1)
    assert len(worker.segments(long)) > 2 and len(worker.segments("a" * 400_000)) == 1
    assert " ".join(worker.segments(long)) == long and spm.verify(worker.model, [t for t in texts if t]) == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = spm.encode(docs, MODEL, key="doc_id", ids=False, verified=3).collect()
    seen = [r["parity"] for r in found if r["parity"] is not None]
    assert 40 < len(seen) < 100 and all(seen) and all(r["parity"] is None for r in found if texts[r["doc_id"]] is None)
    assert spm.encode(docs, MODEL, key="doc_id", ids=False, verified=0).where("parity is not null").count() == 0


def test_joins_of_hot_keys_keep_every_row(spark):
    from orrery.llm import scratch

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    table = rows.where("k is not null and k % 7 <> 2").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        assert sorted(map(str, scratch.join_hot(rows, table, "k", "n", how).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_op3_files_are_bounded_by_bytes_and_records_are_members(spark, tmp_path):
    import glob
    import gzip
    import hashlib

    from orrery.llm import warc

    rng = np.random.default_rng(3)
    big = "".join(map(chr, rng.integers(0x20, 0x2FF, 2 << 20))) * 14 + "end"
    rows = [(i, "u", f"<p>{i}</p>" * 400) for i in range(300)] + [(1000, "big", big), (1001, "big", big), (1002, "u", None)]
    assert len(big.encode()) > 50_000_000
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, file_bytes=200_000)
    files = glob.glob(f"{tmp_path}/w/*.txt")
    raw = [gzip.decompress(open(f, "rb").read()) for f in files]
    assert len(files) > 5 and sorted(map(len, raw))[-3] < 202_000
    assert sum(len(list(warc.parse(r))) for r in raw) == 3 * len(rows)
    nested = warc.assemble(warc.read(spark, path)).collect()
    assert len(nested) == len(rows) and all(r["request"] and r["metadata"] for r in nested)
    found = {(r["main"]["type"], r["main"]["payload_bytes"], r["main"]["payload_sha256"]) for r in nested if r["main"]["target_uri"] == "big"}
    head = ("response", len(big.encode()), hashlib.sha256(big.encode()).hexdigest())
    assert found == {head, ("revisit", 0, hashlib.sha256(b"").hexdigest())}


def test_op3_reads_others_archives(spark, tmp_path):
    import gzip

    from orrery.llm import warc

    def record(kind, fields, block):
        lines = "".join(f"{n}: {v}\r\n" for n, v in fields)
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [
        record("warcinfo", [], b"software: x\r\n"), record("response", [("WARC-Record-ID", "<a>"), ("WARC-Target-URI", "x")], b"A"), record("response", [("WARC-Record-ID", "<b>")], b"B" * 300_000),
        record("request", [("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<a>"), ("warc-concurrent-to", "<b>")], b"GET"), record("metadata", [("WARC-Concurrent-To", "<nobody>")], b""), record("response", [], b"C"), record("response", [], b"D"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for name in ("plain.warc", "members.warc.gz"):
        found = warc.assemble(warc.read(spark, f"file://{tmp_path}/{name}")).collect()
        told = sorted((bytes(r["main"]["payload"])[:1], bytes(r["request"]["payload"]) if r["request"] else None, r["metadata"] is None) for r in found)
        assert told == [(b"A", b"GET", True), (b"B", b"GET", True), (b"C", None, True), (b"D", None, True)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(records[2][:-6]))
