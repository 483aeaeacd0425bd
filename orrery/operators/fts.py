"""Ranked full-text search over materialised postings.

A stored index is two derived tables: postings (term, document, occurrences, places, the document's length), partitioned by a hash of
the term and sorted by it, so that a query reads its own terms' row groups only; and one row of corpus figures. It is rebuilt from the
base rows, so it cannot go stale. Terms are runs of letters and digits, lower-cased, without the marks of Latin letters; a query's
words are ASCII words, and one that holds underscores is a phrase. A document must hold every phrase. Scores are negative BM25
(k1 = 1.2, b = 0.75), the best first; inverse frequencies that would not be positive count as 1e-6. Figures are those of the whole
corpus: filters choose rows, they do not change scores.

Defined cases: null and empty texts have no terms but count as documents; a query without words finds nothing; ties go by key; keys
must be unique.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import folders
from . import relational

#: Terms of all questions, or places where they are found, up to which they are sent to every executor.
BROADCAST_TERMS = 100_000
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TERM = r"[\p{L}\p{N}]+"


def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, and in the same order the letters without; the marks themselves come last and have no counterpart."""
    found = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            found.append((chr(code), base))
    return "".join(c for c, _ in found) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in found)


_MARKED, _PLAIN = _marked_letters()
_FOLDED = str.maketrans(_MARKED[: len(_PLAIN)], _PLAIN, _MARKED[len(_PLAIN) :])


def folded(text: Column) -> Column:
    """Without the marks of Latin letters. ASCII texts are left as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, _MARKED, _PLAIN))


def terms(text: str | Column, fold: bool = True) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.lower(folded(text) if fold else text), F.lit(TERM), 0)


def query_phrases(query: str) -> list[list[str]]:
    """A query's words, each as the terms it is indexed by; a word of underscores alone has none and is dropped."""
    words = re.findall(r"\w+", query, re.ASCII)
    return [p for p in ([t for t in w.lower().split("_") if t] for w in words) if p]


def _and_equal(term: str) -> Callable[[Column, Column], Column]:
    return lambda held, t: held & (t == term)


_POSTING = "bucket int, term string, doc_id {key}, tf long, places array<struct<col:int,pos:int>>, dl long"
_CORPUS = "n double, avgdl double, buckets int"


#: Documents whose postings a worker makes at a time.
_DOCUMENTS = 256


def _postings(sized: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(doc_id, dl, term, tf, places) of documents with lists of terms; a document's terms stand in one row, so no word is exchanged by itself."""
    places = pa.struct([("col", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _DOCUMENTS):
                batch = whole_batch.slice(at, _DOCUMENTS)
                lengths = [batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
                words = pa.concat_arrays([batch.column(c).flatten() for c in columns]).dictionary_encode()
                doc = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in lengths])
                if not len(doc):
                    continue
                col = np.repeat(np.arange(len(columns), dtype=np.int32), [n.sum() for n in lengths])
                pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths]).astype(np.int32)
                key = doc * len(words.dictionary) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                begins = np.flatnonzero(np.diff(key[order], prepend=-1)).astype(np.int32)
                ends = np.append(begins, np.int32(len(order)))
                first = order[begins]
                whose = pa.array(doc[first])
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(col[order]), pa.array(pos[order])], fields=list(places)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whose), batch.column("dl").take(whose), words.dictionary.take(words.indices.take(pa.array(first))), pa.array(np.diff(ends).astype(np.int64)), listed], names=["doc_id", "dl", "term", "tf", "places"])

    kind = dict(sized.dtypes)["doc_id"]
    return sized.select("doc_id", "dl", *columns).mapInArrow(run, f"doc_id {kind}, dl long, term string, tf long, places array<struct<col:int,pos:int>>")


@dataclass
class Index:
    """Either `lists` (doc_id, and each column's terms as a list), as an index that has just been built has: a query then counts its
    phrases in the lists, in one pass for the corpus's figures and one for the scores, without a shuffle. Or a stored index's
    `postings` and `corpus`."""

    lists: DataFrame | None = None
    postings: DataFrame | None = None
    corpus: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str, columns: Sequence[str], fold: bool = True) -> Index:
        return cls(docs.select(F.col(key).alias("doc_id"), *[terms(c, fold).alias(f"c{i}") for i, c in enumerate(columns)]))

    def write(self, path: str, buckets: int = 64) -> None:
        """Store the index. A term of very many documents is parted over several files of its bucket."""
        columns = [c for c in self.lists.columns if c != "doc_id"]
        length = sum((F.size(c) for c in columns), F.lit(0)).cast("long")
        sized = self.lists.withColumn("dl", length)
        held = _postings(sized, columns)
        dealt = held.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        figures = sized.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.lit(buckets).alias("buckets"))
        figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def read(cls, spark: SparkSession, path: str, key_type: str = "bigint") -> Index:
        return cls(None, spark.read.schema(_POSTING.format(key=key_type)).parquet(f"{path}/postings"), spark.read.schema(_CORPUS).parquet(f"{path}/corpus"))

    def _occurrences(self, phrase: list[str], buckets: int) -> DataFrame:
        """(doc_id, tf, dl) of the documents that hold a phrase."""
        of = lambda t: self.postings.where((F.col("bucket") == zlib.crc32(t.encode()) % buckets) & (F.col("term") == t))
        rows = of(phrase[0])
        if len(phrase) == 1:
            return rows.select("doc_id", "tf", "dl")
        rows = rows.select("doc_id", "dl", "places")
        for step, term in enumerate(phrase[1:], 1):
            there = of(term).select("doc_id", F.transform("places", lambda x: F.struct(x["col"].alias("col"), (x["pos"] - F.lit(step)).alias("pos"))).alias("there"))
            rows = rows.join(there, "doc_id").select("doc_id", "dl", F.array_intersect("places", "there").alias("places"))
        return rows.where(F.size("places") > 0).select("doc_id", F.size("places").cast("long").alias("tf"), "dl")

    def _looked_up(self, phrases: list[list[str]]) -> DataFrame:
        """The scores from the stored postings of the query's terms."""
        corpus = self.corpus.first()
        parts = [self._occurrences(p, corpus["buckets"]).withColumn("phrase", F.lit(k)) for k, p in enumerate(phrases)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # one row for each phrase reaches the driver
        held = {r["phrase"]: r["n"] for r in found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).collect()}
        idf = F.lit(0.0)
        for k, d in held.items():
            raw = F.log((F.lit(corpus["n"]) - F.lit(float(d)) + 0.5) / (F.lit(float(d)) + 0.5))
            idf = F.when(F.col("phrase") == k, F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))).otherwise(idf)
        tf = F.col("tf").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(corpus["avgdl"])))
        if len(phrases) == 1:
            return found.select("doc_id", (-part).alias("score"))
        # summed in the phrases' order, so that equal documents have equal scores
        scored = found.withColumn("part", part).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("phrase", "part"))).alias("p"))
        return scored.where(F.size("p") == len(phrases)).select("doc_id", (-F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))

    def _counted(self, phrases: list[list[str]]) -> DataFrame:
        """The scores by counting in the lists of terms."""
        columns = [c for c in self.lists.columns if c != "doc_id"]

        def times(phrase: list[str], c: str) -> Column:
            # the list must stand outside the lambdas, or it would be made anew for each of its elements
            begins = F.transform(c, lambda t: t == phrase[0])
            for k, term in enumerate(phrase[1:], 2):
                begins = F.zip_with(begins, F.slice(c, k, 1 << 30), _and_equal(term))
            return F.size(F.filter(begins, lambda b: b))

        add = lambda parts: sum(parts[1:], parts[0])
        rows = self.lists.select("doc_id", add([F.size(c) for c in columns]).cast("double").alias("dl"), *[add([times(p, c) for c in columns]).cast("double").alias(f"t{k}") for k, p in enumerate(phrases)])
        figures = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{k}") > 0).cast("double").alias(f"d{k}") for k in range(len(phrases))])
        score, held = F.lit(0.0), F.lit(True)
        for k in range(len(phrases)):
            t, d = F.col(f"t{k}"), F.col(f"d{k}")
            raw = F.log((F.col("n") - d + 0.5) / (d + 0.5))
            score = score + F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
            held = held & (t > 0)
        return rows.where(held).crossJoin(F.broadcast(figures)).select("doc_id", (-score).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """(doc_id, score) of every document that holds all of the query's phrases."""
        phrases = query_phrases(query)
        if not phrases:
            rows = self.lists if self.lists is not None else self.postings
            return rows.limit(0).select("doc_id", F.lit(0.0).alias("score"))
        return self._counted(phrases) if self.lists is not None else self._looked_up(phrases)


def search(index: Index, docs: DataFrame, key: str, query: str, limit: int = 20, condition: Column | None = None) -> DataFrame:
    """The best `limit` rows of ``docs`` that meet the condition, with their score; ties by key.

    Only keys and scores are ranked, and of the rows only the best are looked up; a condition is met by keys before that.
    """
    scored = index.scores(query).withColumnRenamed("doc_id", key)
    if condition is not None:
        scored = scored.join(docs.where(condition).select(key), key, "left_semi")
    best = scored.orderBy("score", key).limit(limit)
    return best.join(docs, key).orderBy("score", key)


def phrases(question: str | Column) -> Column:
    """A question's words, each as the terms it is indexed by; the same as `query_phrases`."""
    question = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    words = F.regexp_extract_all(question, F.lit(r"[0-9a-zA-Z_]+"), 0)
    return F.filter(F.transform(words, lambda w: F.filter(F.split(F.lower(w), "_"), lambda t: t != "")), lambda p: F.size(p) > 0)


def asked(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(q, phrase, unit, terms) of each word of each question; a unit is a word's terms joined by underscores."""
    words = questions.select(F.col(key).alias("q"), F.posexplode(phrases(text)).alias("phrase", "terms"))
    return words.withColumn("unit", F.array_join("terms", "_"))


def weight(held: Column, documents: Column) -> Column:
    """Inverse frequency of what `held` of so many documents have."""
    raw = F.log((documents - held + 0.5) / (held + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def part(idf: Column, tf: Column, dl: Column, mean: Column) -> Column:
    """What one word adds to a document's score."""
    return part_of(idf, tf.cast("double"), dl, mean)


def part_of(idf, tf, dl, mean):  # noqa: ANN001, ANN201
    """The same of columns or of arrays of double numbers, by the same steps."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def whole(parts: DataFrame, needed: DataFrame) -> DataFrame:
    """(q, doc_id, score) of the documents that hold all words of a question.

    parts: q, doc_id and parts (a list of phrase and part) for each unit that a document holds; needed: q and its units. Parts are summed in the
    words' order, so that equal documents have equal scores.
    """
    held = parts.groupBy("q", "doc_id").agg(F.count(F.lit(1)).alias("held"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts")).join(needed, "q").where("held = units")
    return held.select("q", "doc_id", (-F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))


def search_many(index: Index, questions: DataFrame, limit: int = 10, key: str = "query_id", text: str = "question", name: str = "id") -> DataFrame:
    """(`key`, rank from 1, `name`, score): each question's best documents in a fresh index, all questions in one plan.

    Ids of questions must be unique. The lists of terms are gone through once for the words of all questions; `ranked.Index` is for tables that
    are too large for that.
    """
    lists = index.lists
    columns = [c for c in lists.columns if c != "doc_id"]
    sized = lists.withColumn("dl", sum((F.size(c) for c in columns), F.lit(0)).cast("long"))
    figures = sized.agg(F.count(F.lit(1)).cast("double").alias("documents"), F.avg("dl").alias("mean"))
    words = folders.stored(asked(questions, key, text), "asked")
    few_words = words.count() <= BROADCAST_TERMS
    needed = words.groupBy("q").agg(F.countDistinct("unit").alias("units"))
    units = folders.stored(words.select("unit", "terms").distinct(), "units")
    wanted = units.select(F.explode("terms").alias("term")).distinct()
    wanted = relational.side(wanted, wanted.count() <= BROADCAST_TERMS)
    # documents' terms are counted where they are read, and of them only what questions ask for goes on
    held = folders.stored(_postings(sized, columns).join(wanted, "term", "left_semi"), "held")
    alone = units.where(F.size("terms") == 1).select("unit")
    few_alone = alone.count() <= BROADCAST_TERMS
    counted = held.select("term", "doc_id", "tf", "dl")
    counted = counted if few_alone else relational.side(counted, held.count() <= BROADCAST_TERMS)
    single = counted.join(F.broadcast(alone) if few_alone else alone, F.col("term") == F.col("unit")).select("unit", "doc_id", "tf", "dl")
    steps = units.where(F.size("terms") > 1).select("unit", F.size("terms").alias("length"), F.posexplode("terms").alias("step", "term"))
    places = held.join(relational.side(steps, steps.count() <= BROADCAST_TERMS), "term").select("unit", "length", "step", "doc_id", "dl", F.explode("places").alias("place"))
    begins = places.groupBy("unit", "length", "doc_id", "dl", F.col("place.col").alias("col"), (F.col("place.pos") - F.col("step")).alias("begin")).agg(F.count(F.lit(1)).alias("steps"))
    several = begins.where("steps = length").groupBy("unit", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("unit", "doc_id", "tf", "dl")
    found = folders.stored(single.unionByName(several), "found")
    few_found = found.count() <= BROADCAST_TERMS
    idf = found.groupBy("unit").agg(F.count(F.lit(1)).cast("double").alias("df")).crossJoin(F.broadcast(figures)).select("unit", "mean", weight(F.col("df"), F.col("documents")).alias("idf"))
    units_of = words.groupBy("q", "unit").agg(F.collect_list("phrase").alias("phrases")).join(relational.side(idf, few_words or few_found), "unit")
    parts = (found.join(F.broadcast(units_of), "unit") if few_words else relational.side(found, few_found).join(units_of, "unit")).select("q", "doc_id", F.transform("phrases", lambda p: F.struct(p.alias("phrase"), part(F.col("idf"), F.col("tf"), F.col("dl"), F.col("mean")).alias("part"))).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "doc_id"))
    best = whole(parts, relational.side(needed, few_words)).withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.select(F.col("q").alias(key), "rank", F.col("doc_id").alias(name), "score")


def snippet(text: str | Column, query: str, most: int = 20, before: str = ">>>", after: str = "<<<", gap: str = "...") -> Column:
    """The run of `most` words with the most distinct query terms, the terms marked."""
    wanted = {t for p in query_phrases(query) for t in p}

    def one(body: str | None) -> str | None:
        if body is None:
            return None
        spans = [(m.start(), m.end(), m.group().lower() in wanted) for m in re.finditer(r"[^\W_]+", body)]
        if not spans:
            return body
        starts = range(max(1, len(spans) - most + 1))
        best = max(starts, key=lambda i: (len({body[a:b].translate(_FOLDED).lower() for a, b, hit in spans[i : i + most] if hit}), -i))
        chosen = spans[best : best + most]
        out, at = [gap if best else body[: chosen[0][0]]], chosen[0][0]
        for a, b, hit in chosen:
            out += [body[at:a], before + body[a:b] + after if hit else body[a:b]]
            at = b
        return "".join([*out, gap if best + most < len(spans) else body[at:]])

    run = F.pandas_udf(lambda s: s.map(one) if isinstance(s, pd.Series) else s, "string")
    return run(F.col(text) if isinstance(text, str) else text)
