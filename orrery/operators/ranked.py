"""Ranked search of many questions at once over an index that is kept in step with its table.

An index is a folder of immutable segments and a manifest that names the live ones. A segment deals its documents into blocks of some thousand
documents of like length and holds, for each block and term, the documents with their occurrences and places (`postings`), and for each term and
block how many documents have it and the few pairs of (occurrences, length) that none of the others beats (`heads`): from these follows the greatest
score that a term can have in a block, whatever the corpus's figures are by then. Document frequencies are sums of the heads, the number of documents
and their length stand in the manifest, so neither is counted at query time.

Adding, replacing and deleting rows write new segments only. A deletion writes which documents went and heads with negative counts; segments of
like size are merged when there are several of them. A manifest is created, never overwritten: of two writers who start from the same version, one fails.

A search turns questions into a table of their terms, joins it to the heads and bounds each (question, block) from above. The best blocks of each
question are scored first; their k-th score then rules out every block whose bound is below it, and only the others' postings are read. The number of
jobs is the same for one question and for a million. Scores, words and phrases are those of `fts`.

What is exchanged: when a segment is written, each document once, as one text of its terms, to its block; in a search, postings without places and the
questions of a block, which meet in one task that gives back the best documents of each question in that block, never all that hold a word.

Defined cases: null and empty texts are documents without terms; a question without words finds nothing; ties go by key; rows with a null key are not
indexed; of rows with equal keys given at once, the one whose text has the least hash stays; deleting a key that isn't there changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import folders
from . import fts

#: Documents of a block; lengths that blocks are parted by; folders of the heads.
BLOCK_DOCUMENTS, LENGTHS, BUCKETS = 2048, 64, 64
#: Terms of all documents of a block, about, beyond which a length class gets more blocks.
BLOCK_TERMS = 1 << 22
#: Questions that meet a block's postings in one task; (question, document) cells that are scored at a time.
TASK_QUESTIONS, CELLS = 200_000, 1 << 20
#: Segments of one size class that are merged; each class is so many times the one before it.
MERGED = 4
#: Terms and blocks of a search up to which they are written into the scan's filter.
FILTERED = 500
_PEAK = "array<struct<tf:bigint,dl:bigint>>"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


@dataclass
class State:
    """What a manifest says: the live segments with their documents and lengths, less those that went, and the deletions that hold for them."""

    version: int = 0
    segments: dict[str, dict] = field(default_factory=dict)
    deletions: list[str] = field(default_factory=list)

    @property
    def documents(self) -> int:
        return sum(s["n"] for s in self.segments.values())

    @property
    def mean_length(self) -> float:
        return sum(s["length"] for s in self.segments.values()) / max(1, self.documents)


def peaks(documents: str | Column) -> Column:
    """The pairs of (tf, dl) in a list of documents that no other beats by more occurrences in fewer terms."""
    pairs = F.array_sort(F.array_distinct(F.transform(documents, lambda d: F.struct(d["dl"].alias("dl"), (-d["tf"]).alias("less")))))
    better = lambda held, x: F.when((F.size(held) == 0) | (F.element_at(held, -1)["tf"] < -x["less"]), F.concat(held, F.array(F.struct((-x["less"]).alias("tf"), x["dl"].alias("dl"))))).otherwise(held)
    return F.aggregate(pairs, F.array().cast(_PEAK), better)


_PLACES = [("col", pa.int32()), ("pos", pa.int32())]


def _of_block(columns: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """The postings of a block's documents, each column being a text of terms with blanks between them."""

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        texts = [pc.split_pattern(docs[c].combine_chunks(), " ") for c in columns]
        lengths = [np.where(pc.equal(docs[c].combine_chunks(), "").to_numpy(zero_copy_only=False), 0, x.value_lengths().to_numpy(zero_copy_only=False)) for c, x in zip(columns, texts, strict=True)]
        flat = pa.concat_arrays([x.flatten() for x in texts])
        words = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        by_term = pc.array_sort_indices(words.dictionary)
        place = np.empty(len(by_term), dtype=np.int64)
        place[by_term.to_numpy()] = np.arange(len(by_term))
        doc = np.concatenate([np.repeat(np.arange(docs.num_rows), n) for n in lengths])
        col = np.repeat(np.arange(len(columns), dtype=np.int32), [n.sum() for n in lengths])
        pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths]).astype(np.int32)
        key = place[words.indices.to_numpy()] * docs.num_rows + doc
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(begins, len(order)).astype(np.int32)
        held = key[order[begins]]
        whose = pa.array(held % docs.num_rows)
        heads = np.flatnonzero(np.diff(held // docs.num_rows, prepend=-1))
        offsets = np.append(heads, len(held)).astype(np.int32)
        tf, dl, term = np.diff(ends).astype(np.int64), docs["dl"].to_numpy()[held % docs.num_rows], held // docs.num_rows
        # as `peaks`: by length, those with more occurrences than any before
        by_length = np.lexsort((-tf, dl, term))
        most = term * (1 << 32) + tf
        peak = by_length[most[by_length] > np.append(-1, np.maximum.accumulate(most[by_length])[:-1])]
        peak_offsets = np.append(0, np.cumsum(np.bincount(term[peak], minlength=len(heads)))).astype(np.int32)
        pairs = pa.ListArray.from_arrays(pa.array(peak_offsets), pa.StructArray.from_arrays([pa.array(tf[peak]), pa.array(dl[peak])], names=["tf", "dl"]))
        places = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(col[order]), pa.array(pos[order])], fields=[pa.field(*f) for f in _PLACES]))
        parts = {"doc_id": docs["doc_id"].combine_chunks().take(whose), "tf": pa.array(tf), "dl": pa.array(dl), "places": places}
        documents = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(parts.values()), fields=[pa.field(k, x.type) for k, x in parts.items()]))
        block = pa.array(np.full(len(heads), docs["block"][0].as_py() if docs.num_rows else 0, dtype=np.int64))
        return pa.table({"block": block, "term": words.dictionary.take(by_term), "n": pa.array(np.diff(offsets).astype(np.int64)), "peaks": pairs, "documents": documents})

    return run


def _gone_of_block(rows: pa.Table, gone: pa.Table) -> pa.Table:
    """How many documents of each of a block's terms went, as negative numbers."""
    ids = rows["ids"].combine_chunks()
    hit = pc.is_in(ids.flatten(), value_set=gone["doc_id"].combine_chunks()).to_numpy(zero_copy_only=False) if gone.num_rows else np.zeros(len(ids.flatten()), dtype=bool)
    at = np.repeat(np.arange(rows.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
    n = np.bincount(at[hit], minlength=rows.num_rows)
    some = pa.array(np.flatnonzero(n))
    return pa.table({"term": rows["term"].combine_chunks().take(some), "block": rows["block"].combine_chunks().take(some), "n": pa.array(-n[n > 0].astype(np.int64))})


#: What postings bring to a block: documents of a unit, documents that went, documents that may be found.
_HOLDS, _WENT, _CHOSEN = 0, 1, 2


def _best_of_block(limit: int, mean: float, only_chosen: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(q, doc_id, score) of the best documents of a block for each question; parts are summed in the words' order, as in `fts.whole`."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        lists = rows["ids"].combine_chunks()
        ids_of = lambda k: lists.filter(pa.array(kind == k)).flatten()
        held = rows.filter(pa.array(kind == _HOLDS)).combine_chunks()
        ids = ids_of(_HOLDS)
        docs = ids.unique()
        docs = docs.take(pc.array_sort_indices(docs))
        doc = pc.index_in(ids, value_set=docs).to_numpy(zero_copy_only=False).astype(np.int64)
        may = np.ones(len(docs), dtype=bool)
        if (kind == _WENT).any():
            may &= ~pc.is_in(docs, value_set=ids_of(_WENT)).to_numpy(zero_copy_only=False)
        if only_chosen:
            may &= pc.is_in(docs, value_set=ids_of(_CHOSEN)).to_numpy(zero_copy_only=False)
        sizes = held["ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if held.num_rows else np.zeros(0, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        idf = np.repeat(held["idf"].to_numpy(), sizes)
        tf, dl = (held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float) if held.num_rows else np.zeros(0) for c in ("tfs", "dls"))
        part = fts.part_of(idf, tf, dl, mean)
        units = held["unit"].combine_chunks()
        words = asked["words"].combine_chunks()
        needed = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if asked.num_rows else np.zeros(0, dtype=np.int64)
        unit = pc.fill_null(pc.index_in(words.flatten(), value_set=units), -1).to_numpy(zero_copy_only=False) if asked.num_rows and held.num_rows else np.full(needed.sum(), -1)
        first = np.cumsum(needed) - needed
        least = pc.fill_null(asked["least"].combine_chunks(), float("-inf")).to_numpy(zero_copy_only=False) if asked.num_rows else np.zeros(0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // max(1, len(docs)))
        for at in range(0, asked.num_rows if len(docs) else 0, step):
            n = needed[at : at + step]
            score, times = np.zeros(len(n) * len(docs)), np.zeros(len(n) * len(docs), dtype=np.int64)
            for k in range(n.max(initial=0)):
                row = np.flatnonzero(n > k)
                of = unit[first[at + row] + k]
                row, of = row[of >= 0], of[of >= 0]
                long = sizes[of]
                cell = np.repeat(starts[of] - np.cumsum(long) + long, long) + np.arange(long.sum())
                to = np.repeat(row * len(docs), long) + doc[cell]
                score[to] += part[cell]
                times[to] += 1
            score, times = score.reshape(len(n), -1), times.reshape(len(n), -1)
            score[(times != n[:, None]) | ~may | (score < least[at : at + step, None])] = -np.inf
            enough = np.partition(score, len(docs) - limit, axis=1)[:, [len(docs) - limit]] if len(docs) > limit else -np.inf
            q, d = np.nonzero((score >= enough) & (score > -np.inf))
            value = score[q, d]
            order = np.lexsort((d, -value, q))
            q, d, value = q[order], d[order], value[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
            out.append((q[keep] + at, d[keep], -value[keep]))
        q, d, value = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int64, float)))
        return pa.table({"q": asked["q"].combine_chunks().take(pa.array(q)), "doc_id": docs.take(pa.array(d)), "score": pa.array(value)})

    return run


class Index:
    """An index in a folder; `key` and `columns` are those of the rows it is made of."""

    def __init__(self, spark: SparkSession, root: str, key: str, columns: Sequence[str], block_documents: int = BLOCK_DOCUMENTS) -> None:
        self.spark, self.root, self.key, self.columns, self.block_documents = spark, root.rstrip("/"), key, list(columns), block_documents

    # --- state ---

    def state(self) -> State:
        target, files = _file_system(self.spark, f"{self.root}/manifests")
        if not files.exists(target):
            return State()
        last = max((f.getPath() for f in files.listStatus(target)), key=lambda p: p.getName())
        stream = files.open(last)
        try:
            return State(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, state: State) -> State:
        """The next version; an error if someone else has written it."""
        state.version += 1
        target, files = _file_system(self.spark, f"{self.root}/manifests/{state.version:012d}.json")
        stream = files.create(target, False)
        stream.write(bytearray(json.dumps(state.__dict__).encode()))
        stream.close()
        return state

    def _of(self, table: str, names: Sequence[str]) -> DataFrame | None:
        """A table's rows of some segments; None without any."""
        if not names:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/segment={n}" for n in names])

    # --- writing ---

    def _segment(self, lists: DataFrame, name: str, number: int) -> dict | None:
        """Write a segment of rows of doc_id and lists of terms; None if there are no rows."""
        lengths = F.coalesce(*[F.lit(None).cast("long")], sum((F.size(c) for c in lists.columns if c != "doc_id"), F.lit(0)).cast("long"))
        sized = lists.withColumn("dl", lengths)
        shares = [(i + 1) / LENGTHS for i in range(LENGTHS - 1)]
        figures = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length"), F.percentile_approx("dl", shares, 1000).alias("cuts")).first()
        if not figures["n"]:
            return None
        cuts = sorted({*(figures["cuts"] or [])}) if figures["n"] > self.block_documents else []
        of_length = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("dl"))) if cuts else F.lit(0)
        sized = sized.withColumn("of_length", of_length)
        # a row for each class: how many blocks its documents are dealt over
        classes = {r["of_length"]: max(1, -(-r["n"] // self.block_documents), -(-r["length"] // BLOCK_TERMS)) for r in sized.groupBy("of_length").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()}
        each = [classes.get(i, 0) for i in range(len(cuts) + 1)]
        at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("of_length"))
        block = F.lit(number << 32) + (at([sum(each[:i]) for i in range(len(each))]) + F.pmod(F.xxhash64("doc_id"), at(each))).cast("long")
        sized.withColumn("block", block).drop("of_length").write.parquet(f"{self.root}/docs/segment={name}")
        stored = self._of("docs", [name])
        columns = [c for c in stored.columns if c not in ("doc_id", "dl", "block", "segment")]
        # terms hold no blanks, so a document travels as one text for each column
        joined = stored.where("dl > 0").select("block", "doc_id", "dl", *[F.array_join(c, " ").alias(c) for c in columns])
        kind = dict(stored.dtypes)["doc_id"]
        postings = joined.groupBy("block").applyInArrow(_of_block(columns), f"block long, term string, n long, peaks {_PEAK}, documents array<struct<doc_id:{kind},tf:bigint,dl:bigint,places:array<struct<col:int,pos:int>>>>")
        # blocks come one after the other, their terms in order: nothing is sorted again
        postings.write.parquet(f"{self.root}/postings/segment={name}")
        self._heads(self._of("postings", [name]).select("term", "block", "n", "peaks"), name)
        return {"n": figures["n"], "length": figures["length"], "number": number}

    def _heads(self, heads: DataFrame, name: str) -> None:
        bucket = F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")
        # exchanged as one number for each pair
        packed = heads.withColumns({"bucket": bucket, "peaks": F.transform("peaks", lambda p: F.shiftleft(p["tf"], 32) + p["dl"])})
        dealt = packed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
        pair = lambda x: F.struct(F.shiftright(x, 32).alias("tf"), x.bitwiseAND(F.lit(0xFFFFFFFF)).alias("dl"))
        dealt.withColumn("peaks", F.transform("peaks", pair)).write.partitionBy("bucket").parquet(f"{self.root}/heads/segment={name}")

    def _number(self, state: State) -> int:
        return 1 + max((s["number"] for s in state.segments.values()), default=state.version)

    def _without(self, state: State, keys: DataFrame) -> None:
        """Write the deletion of some keys and take them from the figures. keys: doc_id, each once."""
        if not state.segments:
            return
        name = f"d{state.version + 1:012d}"
        # ids alone: no document's terms are exchanged
        live = self._present(self._of("docs", list(state.segments)).select("doc_id", "block", "dl", F.col("segment").alias("of")), state)
        live.join(keys, "doc_id", "left_semi").write.parquet(f"{self.root}/gone/segment={name}")
        gone = self.spark.read.parquet(f"{self.root}/gone/segment={name}")
        each = gone.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()  # a row for each segment
        if not each:
            return
        rows = self._of("postings", [r["of"] for r in each]).select("block", "term", F.col("documents.doc_id").alias("ids"))
        counts = rows.groupBy("block").cogroup(gone.select("block", "doc_id").groupBy("block")).applyInArrow(_gone_of_block, "term string, block long, n long")
        self._heads(counts.withColumn("peaks", F.array().cast(_PEAK)), name)
        state.deletions.append(name)
        for r in each:
            own = state.segments[r["of"]]
            own["n"], own["length"] = own["n"] - r["n"], own["length"] - r["length"]

    def _live(self, state: State, names: Sequence[str] | None = None) -> DataFrame | None:
        """Rows of the live documents, `of` being their segment."""
        docs = self._of("docs", list(state.segments if names is None else names))
        if docs is None:
            return None
        docs = docs.withColumnRenamed("segment", "of")
        gone = self._of("gone", state.deletions)
        return docs if gone is None else docs.join(gone.select("doc_id", "block"), ["doc_id", "block"], "left_anti")

    def upsert(self, rows: DataFrame) -> State:
        """Add rows, in place of those of the same keys."""
        state = self.state()
        lists = fts.Index.build(rows.where(F.col(self.key).isNotNull()), self.key, self.columns).lists
        texts = [c for c in lists.columns if c != "doc_id"]
        lists = folders.stored(lists, "lists")
        repeated = folders.stored(lists.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        if not repeated.isEmpty():  # only rows of these keys are compared, and only then
            several = lists.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*texts), F.xxhash64(*texts)).alias("one")).select("doc_id", "one.*")
            lists = lists.join(repeated, "doc_id", "left_anti").unionByName(several)
        number = self._number(state)
        if state.segments:
            self._without(state, lists.select("doc_id"))
        name = f"s{state.version + 1:012d}"
        if made := self._segment(lists, name, number):
            state.segments[name] = made
        return self._merged(self._publish(state))

    def delete(self, keys: DataFrame) -> State:
        """Take out the rows whose keys are given, as the column `key`."""
        state = self.state()
        self._without(state, keys.select(F.col(self.key).alias("doc_id")).where("doc_id is not null").distinct())
        return self._merged(self._publish(state))

    def _merged(self, state: State) -> State:
        """Segments of a size class are made one when there are `MERGED` of them; the other segments stay as they are."""
        while True:
            classes: dict[int, list[str]] = {}
            for name, s in state.segments.items():
                size, at = s["n"], 0
                while size > self.block_documents:
                    size, at = size // MERGED, at + 1
                classes.setdefault(at, []).append(name)
            full = next((names for names in classes.values() if len(names) >= MERGED), None)
            if full is None:
                return state
            name, number = f"s{state.version + 1:012d}", self._number(state)
            made = self._segment(self._live(state, full).drop("dl", "block", "of"), name, number)
            state.segments = {k: s for k, s in state.segments.items() if k not in full} | ({name: made} if made else {})
            if not state.segments:
                state.deletions = []
            state = self._publish(state)

    def vacuum(self) -> None:
        """Remove the files of segments and versions that the manifest no longer names; not while an older version is still being read."""
        state = self.state()
        for table in ("docs", "postings", "heads", "gone"):
            target, files = _file_system(self.spark, f"{self.root}/{table}")
            for f in files.listStatus(target) if files.exists(target) else []:
                if f.getPath().getName().removeprefix("segment=") not in (*state.segments, *state.deletions):
                    files.delete(f.getPath(), True)
        target, files = _file_system(self.spark, f"{self.root}/manifests")
        for f in files.listStatus(target):
            if f.getPath().getName() != f"{state.version:012d}.json":
                files.delete(f.getPath(), True)

    # --- searching ---

    def _scanned(self, table: str, state: State, terms: DataFrame) -> DataFrame | None:
        """Rows of a table whose term is among `terms` (each once), with the few terms of a small search in the scan's filter."""
        names = list(state.segments) + (state.deletions if table == "heads" else [])
        rows = self._of(table, names)
        if rows is None:
            return None
        few = [r["term"] for r in terms.limit(FILTERED + 1).collect()]
        if len(few) <= FILTERED:
            rows = rows.where(F.col("term").isin(few))
            if table == "heads":
                rows = rows.where(F.col("bucket").isin(sorted({_bucket(t) for t in few})))
            return rows
        return rows.join(_small(terms), "term", "left_semi")

    def _present(self, rows: DataFrame, state: State) -> DataFrame:
        """Rows of doc_id and block without those of documents that went."""
        gone = self._of("gone", state.deletions)
        return rows if gone is None else rows.join(gone.select("doc_id", "block"), ["doc_id", "block"], "left_anti")

    def _phrases(self, state: State, asked: DataFrame) -> DataFrame | None:
        """(unit, block, n, peaks, documents) of the units of several terms that are asked for; None without any."""
        several = asked.where(F.size("terms") > 1).select("unit", "terms").distinct()
        wanted = several.select("unit", F.size("terms").alias("length"), F.posexplode("terms").alias("step", "term"))
        if several.isEmpty():
            return None
        rows = self._scanned("postings", state, wanted.select("term").distinct())
        if rows is None:
            return None
        spread = rows.join(wanted, "term").select("unit", "length", "block", "step", F.explode("documents").alias("d"))
        spread = spread.select("unit", "length", "block", "step", "d.doc_id", "d.dl", F.explode("d.places").alias("place"))
        begins = spread.groupBy("unit", "length", "block", "doc_id", "dl", F.col("place.col").alias("col"), (F.col("place.pos") - F.col("step")).alias("begin")).agg(F.count(F.lit(1)).alias("steps"))
        held = self._present(begins.where("steps = length"), state).groupBy("unit", "block", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        found = held.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("documents"))
        return folders.stored(found.withColumn("peaks", peaks("documents")), "phrases")

    def search(self, questions: DataFrame, limit: int = 10, key: str = "query_id", text: str = "question", condition: DataFrame | None = None, report: bool = False) -> DataFrame:
        """(`key`, rank from 1, the index's key, score) of each question's best documents; those of `condition` only, if these keys are given.

        With `report` instead a row for each question: the blocks that hold all its words, and how many of them were scored first and later.
        """
        state = self.state()
        asked = folders.stored(fts.asked(questions, key, text), "asked")
        words = F.transform(F.array_sort(F.collect_list(F.struct("phrase", "unit"))), lambda w: w["unit"])
        needed = folders.stored(asked.groupBy("q").agg(words.alias("words")).withColumn("units", F.size(F.array_distinct("words"))), "needed")
        heads = self._scanned("heads", state, asked.where(F.size("terms") == 1).select(F.col("unit").alias("term")).distinct())
        own_key = self.spark.read.parquet(f"{self.root}/docs/segment={next(iter(state.segments))}").schema["doc_id"].dataType if state.segments else None
        if heads is None:
            empty = asked.limit(0)
            if report:
                return empty.select(F.col("q").alias(key), *[F.lit(0).cast("long").alias(c) for c in ("blocks", "first", "later")])
            return empty.select(F.col("q").alias(key), F.lit(0).alias("rank"), F.lit(None).cast(own_key or "string").alias(self.key), F.lit(0.0).alias("score"))
        heads = heads.select(F.col("term").alias("unit"), "block", "n", "peaks")
        long = self._phrases(state, asked)
        if long is not None:
            heads = heads.unionByName(long.select("unit", "block", "n", "peaks"))
        if state.deletions:
            heads = heads.groupBy("unit", "block").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("peaks")).alias("peaks")).where("n > 0")
        heads = folders.stored(heads, "heads")

        documents, mean = float(state.documents), state.mean_length
        idf = heads.groupBy("unit").agg(F.sum("n").cast("double").alias("df")).select("unit", fts.weight(F.col("df"), F.lit(documents)).alias("idf"))
        idf = folders.stored(idf, "weights")
        # what a unit adds to a block at most is worked out once for all questions
        most = F.array_max(F.transform("peaks", lambda p: fts.part(F.col("idf"), p["tf"], p["dl"], F.lit(mean))))
        best_parts = heads.join(_small(idf), "unit").select("unit", "block", "n", most.alias("most"))
        times = asked.groupBy("q", "unit").agg(F.count(F.lit(1)).alias("times"))
        bounds = best_parts.join(_small(times), "unit").select("q", "block", "n", (F.col("most") * F.col("times")).alias("most"))
        bounds = bounds.groupBy("q", "block").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("held"), F.min("n").alias("n")).join(_small(needed.select("q", "units")), "q").where("held = units")
        ahead = Window.partitionBy("q").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
        bounds = folders.stored(bounds.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("q", "block", "bound", (F.col("before") < 2 * limit).alias("first")), "bounds")

        shares = -(-needed.count() // TASK_QUESTIONS) or 1
        share = F.pmod(F.xxhash64("q"), F.lit(shares)).cast("int")
        nothing = lambda kind: F.lit(None).cast(kind)

        def scored(pairs: DataFrame) -> DataFrame:
            """(q, doc_id, score) of the best documents in the given blocks that hold all of a question's words."""
            wanted = pairs.join(_small(needed.select("q", "words")), "q").select("block", share.alias("share"), "q", "words", "least")
            names = wanted.select(F.explode("words").alias("term")).distinct()
            each = lambda c: F.col(f"documents.{c}")
            single = self._scanned("postings", state, names).select(F.col("term").alias("unit"), "block", each("doc_id").alias("ids"), each("tf").alias("tfs"), each("dl").alias("dls"))
            if long is not None:
                single = single.unionByName(long.select("unit", "block", each("doc_id").alias("ids"), each("tf").alias("tfs"), each("dl").alias("dls")))
            rows = single.join(_small(idf), "unit").select(F.lit(_HOLDS).alias("kind"), "unit", "block", "idf", "ids", "tfs", "dls")

            def also(kind: int, ids: DataFrame) -> DataFrame:
                listed = ids.groupBy("block").agg(F.collect_list("doc_id").alias("ids"))
                return rows.unionByName(listed.select(F.lit(kind).alias("kind"), nothing("string").alias("unit"), "block", nothing("double").alias("idf"), "ids", nothing("array<bigint>").alias("tfs"), nothing("array<bigint>").alias("dls")))

            if (gone := self._of("gone", state.deletions)) is not None:
                rows = also(_WENT, gone.select("block", "doc_id"))
            if condition is not None:
                chosen = condition.select(F.col(self.key).alias("doc_id")).distinct()
                rows = also(_CHOSEN, self._of("docs", list(state.segments)).select("block", "doc_id").join(chosen, "doc_id", "left_semi"))
            blocks = [r["block"] for r in pairs.select("block").distinct().limit(FILTERED + 1).collect()]
            if len(blocks) <= FILTERED:
                rows = rows.where(F.col("block").isin(blocks))
            rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))) if shares > 1 else F.lit(0))
            schema = f"q {dict(needed.dtypes)['q']}, doc_id {own_key.simpleString()}, score double"
            return wanted.groupBy("block", "share").cogroup(rows.groupBy("block", "share")).applyInArrow(_best_of_block(limit, mean, condition is not None), schema)

        def best(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "doc_id"))).where(F.col("rank") <= limit)

        first = folders.stored(best(scored(bounds.where("first").withColumn("least", nothing("double")))), "first")
        kth = first.where(F.col("rank") == limit).select("q", (-F.col("score")).alias("kth"))
        # bounds are sums in another order than scores: what may be below by rounding alone is read
        later = bounds.where("not first").join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("kth"))).select("q", "block", F.col("kth").alias("least"))
        later = folders.stored(later, "later")
        if report:
            counts = bounds.groupBy("q").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("first").alias("first"))
            return counts.join(later.groupBy("q").agg(F.count(F.lit(1)).alias("later")), "q", "left").select(F.col("q").alias(key), "blocks", "first", F.coalesce("later", F.lit(0)).alias("later"))
        found = first.drop("rank")
        if not later.isEmpty():
            found = best(found.unionByName(scored(later))).drop("rank")
        return best(found).select(F.col("q").alias(key), "rank", F.col("doc_id").alias(self.key), "score")


def _small(frame: DataFrame) -> DataFrame:
    """Sent to every executor if its rows are few."""
    return F.broadcast(frame) if frame.count() <= fts.BROADCAST_TERMS else frame


def _bucket(term: str) -> int:
    import zlib

    return zlib.crc32(term.encode()) % BUCKETS
