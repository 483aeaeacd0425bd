"""Any number of phrases sought in any number of texts, in one pass over the texts for each automaton of bounded size.

Phrases are dealt by a hash into shards of at most `SHARD_BYTES` of text. For each shard an Aho-Corasick automaton is built by each task from the
shard's phrases, which are broadcast, and run over Arrow batches of texts; its work grows with the texts and what is found, not with the number of phrases.

Defined cases: null texts hold nothing; empty and null phrases are not sought; a phrase that occurs several times in a text is told once for each
row; repeated rows are told each by itself; without phrases the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in an automaton, which takes some thirty times as many.
SHARD_BYTES = 4 << 20


def held(texts: DataFrame, phrases: DataFrame, key: str = "query_id", text: str = "text", phrase: str = "phrase", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, phrase): each distinct phrase that a text has as a part of itself."""
    spark = texts.sparkSession
    wanted = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    shards = max(1, -(-(wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) // shard_bytes))
    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = source.schema["key"].dataType.simpleString()
    out = None
    for shard in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == shard)
        listed = spark.sparkContext.broadcast([r[0] for r in own.toLocalIterator()])  # bounded by the shard's size

        def run(batches: Iterable[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, p in enumerate(listed.value):
                automaton.add_word(p, i)
            automaton.make_automaton()
            for batch in batches:
                at: list[int] = []
                found: list[int] = []
                for row, t in enumerate(batch.column("text").to_pylist() if listed.value else []):
                    mine = {i for _, i in automaton.iter(t)}
                    found += mine
                    at += [row] * len(mine)
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array([listed.value[i] for i in found], pa.string())], names=["key", "phrase"])

        rows = source.mapInArrow(run, f"key {kind}, phrase string")
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("key").alias(key), "phrase")
