"""Removal of repeated passages, found by difference-cover anchors.

A difference cover modulo v is a set D of residues such that for any two places i and j some shift d < v brings both i + d
and j + d to residues in D. Of every text only the runs of ``window - v + 1`` words that begin at places in D are hashed: two
equal windows, wherever they begin, hold such an anchor at the same shift, so both hold an anchor that occurs twice. Then
each shared anchor extends: the windows around it, and only these, are hashed whole and counted over the corpus. A window
whose word sequence also begins anywhere else is a repeat, and every word it covers goes.

All passes work on one exchange of the texts into chunks (see `lookup`). An anchor is told by 64 bits of hash, since a
chance equality only makes windows to be looked at; a window by 96.

Defined cases: null and empty texts have no words; a text shorter than the window loses nothing; equal rows are repeats of
each other; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lookup, scratch, tokens

#: Difference covers by period: perfect difference sets (fixed values of finite projective planes).
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
}
_QUESTION = "__bucket int, __chunk long, kind int, hashes binary, checks binary, counts binary"
_ANSWER = "__chunk long, kind int, bucket int, n int, shared binary"


def period_for(window: int) -> int:
    """The longest known period that leaves an anchor more than a third of the window."""
    return max(v for v in COVERS if v == 1 or 3 * (window - v + 1) > window)


def _sorted_texts(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that every pass over the chunk finds again."""
    return table.sort_by([("__key", "ascending"), ("__hash", "ascending")])


class _Chunk:
    """A chunk's words, and what the passes ask about them."""

    def __init__(self, table: pa.Table, window: int, period: int) -> None:
        self.data, offsets = tokens.buffers(table.column("__text"))
        self.words = tokens.split(self.data, offsets, tokens.NON_SPACE, False)
        self.window, self.length = window, window - period + 1
        self.hashes = self.words.hashes()
        place = tokens.inside_text(self.words, self.length)
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        inner = place - np.repeat(self.words.first[:-1], np.maximum(self.words.counts - self.length + 1, 0))
        self.anchors = place[cover[inner % period]]
        self.anchor_hashes = tokens.sequences(self.hashes, self.length)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)

    def windows_near(self, shared: np.ndarray) -> np.ndarray:
        """Beginnings of whole windows that hold a shared anchor."""
        marks = np.zeros(len(self.hashes) + 1, np.int32)
        at = self.anchors[shared]
        text_start = self.words.first[np.searchsorted(self.words.first, at, "right") - 1]
        np.add.at(marks, np.maximum(at - (self.window - self.length), text_start), 1)
        np.add.at(marks, at + 1, -1)
        near = np.cumsum(marks)[:-1] > 0
        whole = tokens.inside_text(self.words, self.window)
        return whole[near[whole]]

    def window_keys(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tokens.spans(self.hashes, begin, begin + self.window), (tokens.spans(self.hashes, begin, begin + self.window, 1) >> np.uint64(32)).astype(np.uint32)

    def covered(self, begin: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + self.window, -1)
        return np.cumsum(marks)[:-1] > 0


def _distinct(hashes: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes (and checks), and where a new one begins in it."""
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    if checks is not None:
        new[1:] |= checks[order[1:]] != checks[order[:-1]]
    return order, new


def _ask(chunk: int, kind: int, n: int, hashes: np.ndarray, checks: np.ndarray | None) -> list[tuple]:
    order, new = _distinct(hashes, checks)
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(order)))
    keys = hashes[order][begins]
    extra = None if checks is None else checks[order][begins]
    return [(b, chunk, kind, lookup.pack_sorted(keys[i:j]), None if extra is None else lookup.pack(extra[i:j]), lookup.pack_counts(counts[i:j])) for b, i, j in lookup.ranges(keys, n)]


def _answer(table: pa.Table) -> pa.Table:
    """For every chunk's question about this bucket: which of its hashes occur more than once in the corpus."""
    rows = table.to_pylist()
    hashes = [lookup.unpack_sorted(r["hashes"], np.uint64) for r in rows]
    counts = np.concatenate([lookup.unpack_counts(r["counts"]) for r in rows])
    checks = None if rows[0]["checks"] is None else np.concatenate([lookup.unpack(r["checks"], np.uint32) for r in rows])
    sizes = [len(h) for h in hashes]
    order, new = _distinct(np.concatenate(hashes), checks)
    shared = np.empty(len(order), bool)
    shared[order] = (np.add.reduceat(counts[order], np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
    parts = np.split(shared, np.cumsum(sizes)[:-1])
    return pa.table({"__chunk": [r["__chunk"] for r in rows], "kind": pa.array([r["kind"] for r in rows], pa.int32()), "bucket": pa.array([r["__bucket"] for r in rows], pa.int32()), "n": pa.array(sizes, pa.int32()), "shared": [np.packbits(p).tobytes() for p in parts]})


def _read_answer(answers: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]).astype(bool) for r in rows] or [np.zeros(0, bool)])


def _told(hashes: np.ndarray, checks: np.ndarray | None, shared: np.ndarray) -> np.ndarray:
    """The answer about the distinct sorted hashes, for each hash."""
    order, new = _distinct(hashes, checks)
    out = np.zeros(len(hashes), bool)
    out[order] = shared[np.cumsum(new) - 1] if len(order) else False
    return out


Finish = Callable[[pa.Table, tokens.Words, np.ndarray], pa.Table]


def _repeats(docs: DataFrame, key: str, text: str, window: int, finish: Finish, schema: T.StructType, chunk_bytes: int) -> DataFrame:
    """`finish` gets a chunk's rows, its words and which of them are covered by repeats."""
    scratch.bound_batches(docs.sparkSession)
    period = period_for(window)
    parts, total = lookup.dealt(docs, key, text, chunk_bytes)
    parts = parts.withColumns({"__text": F.coalesce(text, F.lit("")), "__key": F.col(key), "__hash": F.xxhash64(text)})
    if text in parts.columns:
        parts = parts.drop(text)
    n = lookup.buckets(total, len(COVERS[period]) / period)
    wide = lookup.buckets(total, 0.5)

    def chunk_of(table: pa.Table) -> int:
        return table.column("__chunk")[0].as_py()

    def rows(found: list[tuple]) -> pa.Table:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["__bucket", "__chunk", "kind", "hashes", "checks", "counts"]
        return pa.table({c: pa.array([r[k] for r in found], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    def first(table: pa.Table) -> pa.Table:
        own = _Chunk(_sorted_texts(table), window, period)
        return rows(_ask(chunk_of(table), 1, n, own.anchor_hashes, None))

    def near(own: _Chunk, answers: pa.Table) -> np.ndarray:
        return own.windows_near(_told(own.anchor_hashes, None, _read_answer(answers, 1)))

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Chunk(_sorted_texts(table), window, period)
        return rows(_ask(chunk_of(table), 2, wide, *own.window_keys(near(own, answers))))

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema_table([])
        table = _sorted_texts(table)
        own = _Chunk(table, window, period)
        begin = near(own, answers)
        repeated = _told(*own.window_keys(begin), _read_answer(answers, 2)) if len(begin) else np.zeros(0, bool)
        return finish(table, own.words, own.covered(begin[repeated]))

    def schema_table(_: list) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    narrow = parts.select("__chunk", "__text", "__key", "__hash")
    answers = narrow.groupBy("__chunk").applyInArrow(tokens.released(first), _QUESTION).groupBy("__bucket").applyInArrow(tokens.released(_answer), _ANSWER)
    asked = narrow.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(tokens.released(second), _QUESTION)
    more = asked.groupBy("__bucket").applyInArrow(tokens.released(_answer), _ANSWER)
    return parts.groupBy("__chunk").cogroup(answers.union(more).groupBy("__chunk")).applyInArrow(tokens.released(third), schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, chunk_bytes: int = lookup.CHUNK_BYTES) -> DataFrame:
    """Per row: key, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string").fields])

    def finish(table: pa.Table, words: tokens.Words, covered: np.ndarray) -> pa.Table:
        kept, offsets = tokens.joined(words, ~covered)
        whole = memoryview(kept)
        digests = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
        return pa.table({key: table.column("__key"), "n_words": pa.array(words.counts), "n_removed": pa.array(removed), "kept_sha256": digests})

    return _repeats(docs.select(key, text), key, text, window, finish, schema, chunk_bytes)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, chunk_bytes: int = lookup.CHUNK_BYTES) -> DataFrame:
    """``docs`` with the words of repeated passages taken out of `text`; texts without a repeat stay byte for byte.

    What separated words of a removed passage goes with it, and a line break takes its place.
    """

    names = docs.columns
    others = [c for c in names if c != text]

    def finish(table: pa.Table, words: tokens.Words, covered: np.ndarray) -> pa.Table:
        texts = table.column("__text").to_pylist()
        hits = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
        for k in np.flatnonzero(hits):
            a, b = words.first[k], words.first[k + 1]
            mine = np.concatenate([[False], covered[a:b], [False]])
            begins, ends = np.flatnonzero(mine[1:] & ~mine[:-1]), np.flatnonzero(~mine[1:] & mine[:-1])
            raw, base, out, at = texts[k].encode(), words.offsets[k], [], 0
            for i, j in zip(begins, ends, strict=True):
                out.append(raw[at : words.start[a + i] - base])
                at = words.end[a + j - 1] - base
            out.append(raw[at:])
            texts[k] = b"\n".join(x for x in out if x.strip()).decode()
        row = table.column("__row").combine_chunks().flatten()
        nulls = row[-1].to_pylist()
        columns = dict(zip(others, row[:-1], strict=True)) | {text: pa.array([None if z else t for t, z in zip(texts, nulls, strict=True)], pa.string())}
        return pa.table({c: columns[c] for c in names})

    carried = docs.select(key, text, F.struct(*others, F.col(text).isNull()).alias("__row"))
    return _repeats(carried, key, text, window, finish, docs.schema, chunk_bytes)
