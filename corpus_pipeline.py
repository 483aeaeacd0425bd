"""Cleaning a corpus for training: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet and reads back for the next.
All but the last return the columns of documents. The stages' queries and tests belong to the training-data subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, langid, ngram_join, scratch, spm, substring
from orrery.llm.queries import TOKENIZER

#: A document whose words' labels are less sure than this on average goes, as does one without any letter.
LEAST_LANGUAGE_SCORE = 0.5
NEAR_DUPLICATE_WORDS, NEAR_DUPLICATE_SIMILARITY = 5, (80, 100)
REPEATED_WORDS = 35
BENCHMARK_WORDS, MOST_BENCHMARK_SHARE = 10, 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """Lengths that follow the texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that the labelled ones teach, mixed ones too; null texts and texts without a letter go."""
    chain = langid.train(docs)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("word_score") >= LEAST_LANGUAGE_SCORE)
    return langid.predict(docs, chain, word_score=True).where(sure).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the smallest id, of equal ids that with the smallest hash of its text, of
    equal ids and texts that with the smallest hash of the row; null ids come last. Rows that link with none all stay, whatever their ids."""
    groups = ngram_join.joined(docs, size=NEAR_DUPLICATE_WORDS, similarity=NEAR_DUPLICATE_SIMILARITY)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    groups = scratch.stored(groups.where("root is not null").groupBy("root", row.alias("row")).agg(F.count(F.lit(1)).alias("n")), "groups")
    least = groups.groupBy("root").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("rows"))
    told = scratch.join_hot(groups, scratch.stored(least, "least"), "root", "rows", "inner").select("row", (F.col("row") == F.col("least")).alias("first"), "n")
    told = scratch.stored(told.where("not first or n > 1"), "told")
    hashed = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash")))
    of = lambda frame, how: hashed.join(frame.select(F.col("row").alias("__told")), F.col("__row").eqNullSafe(F.col("__told")), how)
    kept = of(told, "left_anti").select(docs.columns)
    repeated = told.where("first")
    if repeated.isEmpty():
        return kept
    single = of(repeated, "left_semi").groupBy("__row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one"))
    return kept.unionByName(single.select("one.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand elsewhere."""
    return _measured(substring.clean(docs, window=REPEATED_WORDS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; one that is mostly such passages goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _measured(decontaminate.clean(docs, items, window=BENCHMARK_WORDS, most_coverage=MOST_BENCHMARK_SHARE))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with what checks them."""
    return spm.encode(docs.select("doc_id", "source", "lang", "text"), TOKENIZER).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("pieces", pieces),
]

#: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
    return docs
