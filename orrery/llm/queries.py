"""The thirteen operators and the pipeline as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, katz, langid, ngram_join, scratch, sharding, spm, substring, topk, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 24
PARTS, ROUNDS = 4, 4
#: A public SentencePiece model; see `spm.encode` for others.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: A public file of byte-level ranks; see `byte_bpe.encode` for others.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents", "doc_id", "text"), _remainder(7) == 2, order=3, least=1)


def op2_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.report(docs, items, window=10).drop("items")


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.report(pages, scratch.new_path(spark, "warc"))


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_read(spark, sf_dir, "documents", "doc_id", "text"), window=35)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(_read(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER, key="doc_id", ids=False)


def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "toxic")
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    scorer = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(docs.withColumn("held_out", held), scorer).drop("text")


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents", "doc_id", "text"), size=3, similarity=(90, 100))


def op8_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    out = sharding.assign(docs, SHARDS, law="bytes")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    chain = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), chain).drop("text")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, key="doc_id", ids=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), parts=PARTS, entries=256, rounds=ROUNDS, scale=1024)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents", "text", "lang", "source"), least_documents=30, ranks=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    every = (op1_katz_backoff, op2_suffix_automaton, op3_warc_captures, op4_difference_cover, op5_sentencepiece, op6_toxicity_trees, op7_signature_trees, op8_block_max_topk, op9_histogram_shards, op10_language_chain, op11_byte_bpe, op12_vector_codes, op13_source_divergence, pipeline)
    return {f.__name__: f for f in every}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
m AS (SELECT DISTINCT r, p, o.k, item_id FROM o JOIN g USING (s) WHERE o.k = g.k),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
o AS (SELECT r, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
b AS (SELECT s FROM o GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM o JOIN b USING (s))),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d WHERE len(w) > 0),
k AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS s FROM u ANTI JOIN c USING (r, q) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(len(w), 3) - 1), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g AS x JOIN g AS y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n AS x ON x.doc_id = i.a JOIN n AS y ON y.doc_id = i.b WHERE 100 * i.i >= 90 * (x.n + y.n - i.i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS v, a AS t FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.t, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(t) AS t FROM r GROUP BY v) AS m ON m.v = d.doc_id
"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""




def _op12() -> str:
    """Rounds of assignment and means, unrolled: `a` has each part's nearest entry, `c` the codebooks that come of it."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, p, min([d, e]) AS best FROM (
  SELECT v.r, v.p, c.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM parts AS v JOIN c{r} AS c USING (p)) GROUP BY r, p)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY k) AS x FROM (
  SELECT p, e, k, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS m FROM (
    SELECT a.p, CAST(best[2] AS BIGINT) AS e, k, CAST(sum(CAST(v.x[k] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
    FROM a{r} AS a JOIN parts AS v ON v.r = a.r AND v.p = a.p, unnest(range(1, len(v.x) + 1)) AS u(k) GROUP BY ALL)) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS r, vec_id, label, w FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT r, p, list_slice(w, p * (len(w) // {PARTS}) + 1, (p + 1) * (len(w) // {PARTS})) AS x FROM kept, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 256),
{", ".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
told AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (r)),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told, digest
"""


_SHARE = "1 + (1000000000 * (CAST({} AS HUGEINT) + 5)) // ({} + 5 * {})"
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT lang, source, count(term) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT t.* FROM t JOIN k USING (lang, term)) USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format("coalesce(c.c, 0)", "g.n", "v.v")} AS p, {_SHARE.format("k.n", "v.n", "v.v")} AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_automaton": _OP2,
        "op3_warc_captures": _OP3,
        "op4_difference_cover": _OP4,
        "op7_signature_trees": _OP7,
        "op8_block_max_topk": _OP8,
        "op12_vector_codes": _op12(),
        "op13_source_divergence": _OP13,
    }
