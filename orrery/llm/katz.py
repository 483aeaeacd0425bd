"""Katz backoff language model of order 2 or 3: Good-Turing discounted counts, exactly normalised backoff weights.

Texts are read once and become chunks: rows of a stored table with a chunk's distinct word hashes and each token's place among
them. Chunks ask hash-partitioned count tables about their own distinct words and pairs, giving their training counts along, and
get the corpus's counts back; the answers are stored, partitioned by chunk, and the next level is asked from there (see `lookup`).
The weight of what follows a context is

    alpha(u) = (1 - sum of d(c(u w)) c(u w) / c(u)) / (1 - sum of P(w)),    over the retained pairs u w,

both sums exact: each retained pair is owned by one chunk, which adds its share to a table partitioned by u. A token's
probability is then found recursively: the discounted pair, else alpha(u) times the word, and for a word that training never
saw, alpha(u) times what discounting left to all unseen words together. The probabilities of all words and of "unseen"
after any context sum to 1.

Order 3 does the same once more: the discounted triple v u w, else alpha(v u) times the probability of w after u; a text's
first token has the beginning alone as its context. A triple's count is known without asking where one of its two pairs stands
in no other chunk, or in no training text; only the others are asked about. The sums of a context that stands in one chunk alone
are made there, those of the others in the tables.

Counts up to `DISCOUNTED` are discounted by Good-Turing as Katz does, larger ones are trusted; pairs and triples of fewer than
`least` training occurrences are not retained (1 keeps all; Katz's own advice on singletons is `LEAST_PAIR`). Where the counts of counts give no
discount between 0 and 1, there is none; a context that would leave nothing to other words counts one event more. Counts have 64 bits.

`write` stores a model of order 3 as one table partitioned by kind and bucket, and `evaluate` scores texts from that table.

Defined cases: a null or empty text is the end token alone; ids may be null or repeat, and equal rows are dealt like any others;
columns that are not named are left out, so none can clash; of an empty table nothing comes; without any training text every
token is unseen and has probability 1.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import lookup, scratch, tokens

DISCOUNTED, LEAST_PAIR = 5, 2
CHUNK_BYTES = 6 << 20
#: What a row counts for in a chunk's size besides its text.
_ROW_BYTES = 64
_BEGIN, _END = np.uint64(0x0B0B0B0B0B0B0B0B), np.uint64(0x0E0E0E0E0E0E0E0E)
_WORDS, _PAIRS, _CONTEXTS, _TRIPLES, _PAIR_CONTEXTS = 1, 2, 3, 4, 5
#: Events that are counted, and their rows in the counts of counts.
_STAT_ROWS = {_WORDS: 0, _PAIRS: 1, _TRIPLES: 2}
_COUNTS = DISCOUNTED + 1
#: Of a context's retained events: events by count up to DISCOUNTED, the sum of larger counts, and the same of the events without the context's first word.
_VECTOR = 2 * _COUNTS
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_CHUNK = "__chunk long, keys binary, counts binary, words binary, often binary, seq binary"
_ASK = "__bucket int, __chunk long, kind int, hashes binary, amounts binary, marks binary, stats array<long>"
_TOLD = "__chunk long, kind int, bucket int, amounts binary, marks binary, stats array<long>"


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[tuple], columns: str) -> pa.Table:
    named = [c.split(" ") for c in columns.split(", ")]
    return pa.table({c: pa.array([r[k] for r in rows], _TYPES[t]) for k, (c, t) in enumerate(named)})


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of tokens, and each token's hash: the words' and then the end's."""
    words = tokens.split(data, offsets, tokens.NON_SPACE, True)
    counts = words.counts + 1
    out = np.empty(int(counts.sum()), np.uint64)
    out[np.cumsum(counts) - 1] = _END
    out[np.arange(len(words.start)) + words.text_of_word()] = words.hashes()
    return counts, out


def _chunked(docs: DataFrame, held_out: Column, key: str, text: str, chunk_bytes: int) -> DataFrame:
    """The texts as chunks in a stored table, in the order in which they are read: equal rows are dealt like any others."""
    scratch.bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("__key"), (~F.coalesce(held_out, F.lit(False))).alias("__train"), F.col(text).alias("__text"))

    def row(number: int, held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, held[0][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for keys, _, _ in held:
                out.write_batch(keys)
        words, _, word = lookup.distinct(np.concatenate([h for _, _, h in held]))
        often = np.bincount(word, minlength=len(words))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
        counts = np.concatenate([c for _, c, _ in held])
        one = (number, sink.getvalue(), lookup.pack_counts(counts), lookup.pack_sorted(words), lookup.pack_counts(often), lookup.pack_counts(rank[word]))
        return _table([one], _CHUNK).to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch, data, offsets in tokens.slices(batches, "__text", chunk_bytes):
            more = len(data) + _ROW_BYTES * batch.num_rows
            if held and size + more > chunk_bytes:
                yield row(number, held)
                number, held, size = number + 1, [], 0
            held.append((batch.select(["__key", "__train"]), *_hashes(data, offsets)))
            size += more
        if held:
            yield row(number, held)

    return scratch.stored(narrow.mapInArrow(run, _CHUNK), "chunks")


class _Chunk:
    """A chunk's events: each token of each text with the one or two before it."""

    def __init__(self, row: dict, order: int) -> None:
        self.number, self.keys = row["__chunk"], row["keys"]
        self.counts, self.words = lookup.unpack_counts(row["counts"]), lookup.unpack_sorted(row["words"], np.uint64)
        place = np.argsort(-lookup.unpack_counts(row["often"]), kind="stable")
        word = place[lookup.unpack_counts(row["seq"])]
        train = np.repeat(self.rows().column("__train").to_numpy(zero_copy_only=False), self.counts)
        self.events(word, train, order)

    def rows(self) -> pa.Table:
        with pa.ipc.open_stream(self.keys) as source:
            return source.read_all().combine_chunks()

    def events(self, word: np.ndarray, train: np.ndarray, order: int) -> None:
        self.word = word
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        before = np.empty(len(word), np.int64)
        before[1:] = word[:-1]
        before[self.first[:-1]] = len(self.words)
        self.before = before
        self.word_counts = np.bincount(word[train], minlength=len(self.words))
        names = np.append(self.words, _BEGIN)
        self.pairs, first, self.pair = lookup.distinct(tokens.mix(names[before] * _SPREAD + names[word]))
        self.pair_context, self.pair_word = before[first], word[first]
        self.pair_counts = np.bincount(self.pair[train], minlength=len(self.pairs))
        if order > 2:
            inner = np.ones(len(word), bool)
            inner[self.first[:-1]] = False
            self.inner = np.flatnonzero(inner)
            after = self.pair[self.inner - 1]
            _, first, self.triple = lookup.distinct(after * len(self.words) + word[self.inner])
            self.triple_context, self.triple_pair = after[first], self.pair[self.inner[first]]
            self.triple_counts = np.bincount(self.triple[train[self.inner]], minlength=len(first))

    def triple_hashes(self, at: np.ndarray) -> np.ndarray:
        return tokens.mix(self.pairs[self.triple_context[at]] * _SPREAD + self.words[self.pair_word[self.triple_pair[at]]])

    def open_triples(self, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The triples of two spread pairs (those of training that stand in other chunks too), with their hashes, in the hashes' order."""
        at = np.flatnonzero(spread[self.triple_context] & spread[self.triple_pair])
        hashes = self.triple_hashes(at)
        order = np.argsort(hashes)
        return at[order], hashes[order]

    def all_triples(self, spread: np.ndarray, told: np.ndarray, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The triples' counts in the corpus, and those whose share in their context is this chunk's to add."""
        at, _ = self.open_triples(spread)
        counts, own = self.triple_counts.astype(np.int64), np.ones(len(self.triple_counts), bool)
        counts[at], own[at] = told, owned
        return counts, own

    def spread_contexts(self, spread: np.ndarray) -> np.ndarray:
        """The spread pairs that have a word after them."""
        used = np.zeros(len(self.pairs), bool)
        used[self.triple_context] = True
        return np.flatnonzero(spread & used)

    def word_contexts(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of one word that other chunks may have too, the beginning among them, with their hashes, in the hashes' order."""
        names = np.append(self.words, _BEGIN)
        at = np.append(np.flatnonzero(shared), len(self.words))
        order = np.argsort(names[at])
        return at[order], names[at][order]


def _sums(n: int, context: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A row for each of n contexts: what retained events of these counts, and of these counts without the context's first word, add."""
    out = np.zeros((n, _VECTOR), np.int64)
    for base, c in ((0, counts), (_COUNTS, lower)):
        for r in range(1, _COUNTS):
            out[:, base + r - 1] = np.bincount(context[c == r], minlength=n)
        large = c > DISCOUNTED
        np.add.at(out[:, base + DISCOUNTED], context[large], c[large])
    return out


def _stats(**of: np.ndarray) -> list[int]:
    """Of each kind of event: occurrences, distinct ones, and how many of them have 1, 2, ... occurrences."""
    out = np.zeros((len(_STAT_ROWS), 2 + _COUNTS), np.int64)
    for row, counts in of.items():
        own = out[_STAT_ROWS[globals()[f"_{row.upper()}"]]]
        own[:2] = counts.sum(), (counts > 0).sum()
        own[2:] = np.bincount(counts[counts <= _COUNTS], minlength=_COUNTS + 1)[1:]
    return out.ravel().tolist()


def _ask(chunk: _Chunk, n: int, kind: int, hashes: np.ndarray, amounts: np.ndarray, marks: np.ndarray | None = None) -> list[tuple]:
    packed = lambda i, j: None if marks is None else np.packbits(marks[i:j]).tobytes()
    return [(b, chunk.number, kind, lookup.pack_sorted(hashes[i:j]), lookup.pack_counts(amounts[i:j]), packed(i, j), None) for b, i, j in lookup.ranges(hashes, n)]


def _totals(table: pa.Table, discount: np.ndarray) -> pa.Table:
    """What all chunks together gave along with each hash, to each chunk in the order in which it asked. For events that are counted
    also which of them the chunk owns and which others asked about, and the bucket's counts of counts. The sums of a context go only
    to chunks that marked it, as they back off from it, and to all where nothing was discounted: elsewhere its divisor is its count."""
    out: list[tuple] = []
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["__chunk"]))
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        bucket = own[0]["__bucket"]
        if kind < 0:
            out += [(-1, kind, bucket, None, None, r["stats"]) for r in own]
            continue
        hashes = [lookup.unpack_sorted(r["hashes"], np.uint64) for r in own]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        amounts = np.concatenate([lookup.unpack_counts(r["amounts"]) for r in own])
        every = np.concatenate(hashes)
        order = np.argsort(every)
        ranked = every[order]
        new = np.ones(len(every), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        total = np.add.reduceat(amounts[order], starts, axis=0)
        back = np.empty(len(every), np.int64)
        back[order] = np.cumsum(new) - 1
        places = np.split(back, cuts)
        if kind in _STAT_ROWS:
            owned = np.zeros(len(every), bool)
            owned[order[starts]] = True
            shared = (np.diff(np.append(starts, len(every))) > 1)[back]
            marks = [np.packbits([o, x], axis=1).tobytes() for o, x in zip(np.split(owned, cuts), np.split(shared, cuts), strict=True)]
            name = {_WORDS: "words", _PAIRS: "pairs", _TRIPLES: "triples"}[kind]
            out.append((-1, -kind, bucket, None, None, _stats(**{name: total})))
        else:
            level = np.arange(1, _COUNTS)
            whole = total[:, :DISCOUNTED] @ (level * (1 - discount[1:])) <= 1e-9 * (total[:, :DISCOUNTED] @ level + total[:, DISCOUNTED])
            given = [np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(at)).astype(bool) | whole[at] for r, at in zip(own, places, strict=True)]
            marks = [np.packbits(g).tobytes() for g in given]
            places = [at[g] for at, g in zip(places, given, strict=True)]
        out += [(r["__chunk"], kind, bucket, lookup.pack_counts(total[at]), m, None) for r, at, m in zip(own, places, marks, strict=True)]
    return _table(out, _TOLD)


def _read(answers: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals in the order asked, which events are the chunk's own, and which others asked about."""
    amounts, marks = [np.zeros(0, np.int64)], [np.zeros((2, 0), bool)]
    for r in sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"]):
        amounts.append(lookup.unpack_counts(r["amounts"]))
        marks.append(np.unpackbits(np.frombuffer(r["marks"], np.uint8).reshape(2, -1), axis=1, count=len(amounts[-1])).astype(bool))
    return np.concatenate(amounts), *np.concatenate(marks, axis=1)


def _read_sums(answers: list[dict], kind: int, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the contexts' sums were given, and those, both in the order asked."""
    given, sums = [np.zeros(0, bool)], [np.zeros((0, _VECTOR), np.int64)]
    told = {r["bucket"]: r for r in answers if r["kind"] == kind}
    for b, i, j in lookup.ranges(hashes, n):
        given.append(np.unpackbits(np.frombuffer(told[b]["marks"], np.uint8), count=j - i).astype(bool))
        sums.append(lookup.unpack_counts(told[b]["amounts"]))
    return np.concatenate(given), np.concatenate(sums)


def _first(chunk: _Chunk, n: int) -> list[tuple]:
    """Questions about the chunk's words and pairs."""
    return _ask(chunk, n, _WORDS, chunk.words, chunk.word_counts) + _ask(chunk, n, _PAIRS, chunk.pairs, chunk.pair_counts)


def _second(chunk: _Chunk, answers: list[dict], n: int, order: int, least: int) -> list[tuple]:
    """What the chunk's own retained pairs add to the sums of contexts that others may have; with order 3, questions about its open
    triples, and the counts of counts of the others."""
    words, _, common = _read(answers, _WORDS)
    pairs, owned, shared = _read(answers, _PAIRS)
    at = np.flatnonzero(owned & (pairs >= least))
    sums = _sums(len(chunk.words) + 1, chunk.pair_context[at], pairs[at], words[chunk.pair_word[at]])
    at, hashes = chunk.word_contexts(common)
    backs_off = np.zeros(len(sums), bool)
    backs_off[chunk.pair_context[pairs < least]] = True
    out = _ask(chunk, n, _CONTEXTS, hashes, sums[at], backs_off[at])
    if order > 2:
        at, hashes = chunk.open_triples(shared & (pairs > 0))
        out += _ask(chunk, n, _TRIPLES, hashes, chunk.triple_counts[at])
        out.append((chunk.number % n, chunk.number, -_TRIPLES, None, None, None, _stats(triples=np.delete(chunk.triple_counts, at))))
    return out


def _third(chunk: _Chunk, answers: list[dict], n: int, least: int) -> list[tuple]:
    """What the chunk's own retained triples add to the sums of spread contexts."""
    pairs, _, shared = _read(answers, _PAIRS)
    spread = shared & (pairs > 0)
    counts, own = chunk.all_triples(spread, *_read(answers, _TRIPLES)[:2])
    at = np.flatnonzero(own & (counts >= least) & spread[chunk.triple_context])
    asked = chunk.spread_contexts(spread)
    place = np.zeros(len(pairs), np.int64)
    place[asked] = np.arange(len(asked))
    sums = _sums(len(asked), place[chunk.triple_context[at]], counts[at], pairs[chunk.triple_pair[at]])
    backs_off = np.zeros(len(pairs), bool)
    backs_off[chunk.triple_context[counts < least]] = True
    return _ask(chunk, n, _PAIR_CONTEXTS, chunk.pairs[asked], sums, backs_off[asked])


@dataclass
class Model:
    """Corpus-wide figures, and the probabilities that follow from them and a chunk's counts."""

    tokens: int
    distinct: int
    word_discount: np.ndarray
    pair_discount: np.ndarray
    triple_discount: np.ndarray | None = None
    least: int = LEAST_PAIR

    @classmethod
    def of(cls, stats: np.ndarray, least: int) -> Model:
        return cls(int(stats[0, 0]), int(stats[0, 1]), good_turing(stats[0, 2:], 1), good_turing(stats[1, 2:], least), good_turing(stats[2, 2:], least), least)

    def word_probabilities(self, counts: np.ndarray, unseen: float) -> np.ndarray:
        total = self.tokens + (unseen <= 0)
        known = self.discounted(counts, self.word_discount) / max(total, 1)
        return np.where(counts > 0, known, self.left(unseen))

    def left(self, unseen: float) -> float:
        """What all unseen words have together."""
        return 1.0 if not self.tokens else unseen if unseen > 0 else 1 / (self.tokens + 1)

    @staticmethod
    def discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
        return counts * np.append(discount, 1.0)[np.minimum(counts, DISCOUNTED + 1)]


def good_turing(counts: np.ndarray, least: int) -> np.ndarray:
    """Katz's discounts d(0..DISCOUNTED) from the counts of counts 1..DISCOUNTED + 1; 0 below `least`, 1 where none is sound."""
    n = np.concatenate([[0], counts]).astype(float)
    out = np.ones(DISCOUNTED + 1)
    out[:least] = 0
    if n[1] > 0:
        large = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(max(1, least), DISCOUNTED + 1):
            if n[r] > 0 and large < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - large) / (1 - large)
                out[r] = d if 0 < d < 1 else 1.0
    return out


def unseen_mass(stats: np.ndarray, discount: np.ndarray) -> float:
    """1 less the discounted shares of all words."""
    total = stats[0]
    return float(sum((1 - discount[r]) * r * stats[r] for r in range(1, DISCOUNTED + 1)) / total) if total else 1.0


def backoff(events: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts' events as a divisor, and their backoff weights. mass: discounted events; lower: the followers' probability without the first word."""
    rest = events - mass
    more = (events > 0) & (rest <= 1e-9 * events)
    base = np.maximum(events + more, 1)
    return base, np.where(events > 0, np.where(more, 1.0, rest) / base / np.maximum(1 - lower, 1e-300), 1.0)


def _masses(sums: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted sums of contexts' events, and of the same events without the first word."""
    level = np.arange(1, DISCOUNTED + 1)
    return sums[:, :DISCOUNTED] @ (level * discount[1:]) + sums[:, DISCOUNTED], sums[:, _COUNTS : _COUNTS + DISCOUNTED] @ (level * lower[1:]) + sums[:, _COUNTS + DISCOUNTED]


def _mass(context: np.ndarray, counts: np.ndarray, discount: np.ndarray, n: int) -> np.ndarray:
    """Discounted sums of n contexts' events. Events are counted by level first, so that the sums are as exact as those of `_masses`:
    what a context leaves to others may be the small difference of two large sums."""
    out = np.zeros(n)
    for r in range(1, _COUNTS):
        out += r * discount[r] * np.bincount(context[counts == r], minlength=n)
    large = counts > DISCOUNTED
    more = np.zeros(n, np.int64)
    np.add.at(more, context[large], counts[large])
    return out + more


def _context_masses(model: Model, level: int, n: int, own: tuple[np.ndarray, np.ndarray, np.ndarray], told: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same two sums of a chunk's n contexts. own: context, count and count without the first word of each event of contexts that
    the chunk alone has; told: which sums of those at `places` were given, and those. Where none is known, both are 0, and only the
    divisor is needed."""
    discounts = (model.pair_discount, model.word_discount) if level == 2 else (model.triple_discount, model.pair_discount)
    out = [_mass(own[0], c, d, n) for c, d in zip(own[1:], discounts, strict=True)]
    for sums, more in zip(out, _masses(told[1], *discounts), strict=True):
        sums[places[told[0]]] = more
    return out[0], out[1]


Masses = tuple[np.ndarray, np.ndarray]


def token_scores(model: Model, unseen: float, chunk: _Chunk, words: np.ndarray, pairs: np.ndarray, contexts: Masses, triples: tuple[np.ndarray, Masses] | None = None) -> np.ndarray:
    """log10 of each token's probability after those before it. contexts: of the chunk's words, then of the beginning; triples: their
    counts, and the masses of the chunk's pairs as contexts."""
    single = model.word_probabilities(words, unseen)
    end = np.searchsorted(chunk.words, _END)
    events = np.append(words, words[end])
    total = max(model.tokens + (unseen <= 0), 1)
    base, alpha = backoff(events, contexts[0], contexts[1] / total)
    count = pairs[chunk.pair]
    direct = model.discounted(count, model.pair_discount) / base[chunk.before]
    out = np.where(count >= model.least, direct, alpha[chunk.before] * single[chunk.word])
    if triples is not None:
        counts, (mass, lower) = triples
        divisor, weight = backoff(pairs, mass, lower / base[chunk.pair_word])
        count, context = counts[chunk.triple], chunk.pair[chunk.inner - 1]
        direct = model.discounted(count, model.triple_discount) / divisor[context]
        out[chunk.inner] = np.where(count >= model.least, direct, weight[context] * out[chunk.inner])
    return np.log10(out)


def _scored(chunk: _Chunk, answers: list[dict], model: Model, unseen: float, order: int, n: int, schema: pa.Schema) -> pa.Table:
    words, _, common = _read(answers, _WORDS)
    pairs, owned, shared = _read(answers, _PAIRS)
    at = np.flatnonzero(owned & (pairs >= model.least) & ~np.append(common, True)[chunk.pair_context])
    places, hashes = chunk.word_contexts(common)
    own = chunk.pair_context[at], pairs[at], words[chunk.pair_word[at]]
    contexts = _context_masses(model, 2, len(words) + 1, own, _read_sums(answers, _CONTEXTS, hashes, n), places)
    triples = None
    if order > 2:
        spread = shared & (pairs > 0)
        counts, _ = chunk.all_triples(spread, *_read(answers, _TRIPLES)[:2])
        at = np.flatnonzero((counts >= model.least) & ~spread[chunk.triple_context])
        places = chunk.spread_contexts(spread)
        own = chunk.triple_context[at], counts[at], pairs[chunk.triple_pair[at]]
        triples = counts, _context_masses(model, 3, len(pairs), own, _read_sums(answers, _PAIR_CONTEXTS, chunk.pairs[places], n), places)
    score = np.add.reduceat(token_scores(model, unseen, chunk, words, pairs, contexts, triples), chunk.first[:-1])
    count = words[chunk.word]
    base = np.add.reduceat(np.log10((count + 1) / (model.tokens + (model.distinct + 1))), chunk.first[:-1])
    known = np.add.reduceat((count > 0).astype(np.int64), chunk.first[:-1])
    rows = chunk.rows()
    held = [not t for t in rows.column("__train").to_pylist()]
    columns = [rows.column("__key").combine_chunks(), pa.array(held), pa.array(chunk.counts), pa.array(known), pa.array(np.full(len(held), model.tokens)), pa.array(base), pa.array(score)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _asked(chunks: DataFrame, order: int, ask: Callable[[_Chunk], list[tuple]]) -> DataFrame:
    """Questions that follow from the chunks alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _table(ask(_Chunk(batch.slice(k, 1).to_pylist()[0], order)), _ASK).to_batches()
        tokens.release()

    return chunks.mapInArrow(run, _ASK)


def _with_answers(chunks: DataFrame, told: list[DataFrame], order: int, then: Callable[[_Chunk, list[dict]], pa.Table], empty: pa.Table, columns: T.StructType | str) -> DataFrame:
    """What follows from each chunk and the answers that it got."""
    answers = told[0].where("__chunk >= 0")
    for more in told[1:]:
        answers = answers.unionByName(more.where("__chunk >= 0"))

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        return then(_Chunk(chunk.to_pylist()[0], order), rows.to_pylist()) if chunk.num_rows else empty

    return chunks.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(tokens.released(run), columns)


def _answered(asked: DataFrame, what: str, discount: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The answers as a stored table, and the counts of counts of all buckets together. discount: that of the events after contexts."""
    told = scratch.stored(asked.groupBy("__bucket").applyInArrow(tokens.released(lambda t: _totals(t, discount)), _TOLD), what)
    stats = np.zeros((len(_STAT_ROWS), 2 + _COUNTS), np.int64)
    for r in told.where("__chunk < 0").select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        stats.flat[r["k"]] = r["n"]
    return told, stats


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, order: int = 2, least: int = LEAST_PAIR) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, log10 both.

    The model learns from the rows for which `held_out` is not true, and scores all. It is of that order (2 or 3), and retains pairs
    and triples of at least so many training occurrences.
    """
    if order not in (2, 3):
        raise ValueError("orders 2 and 3 are supported")
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    result = to_arrow_schema(schema)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = lookup.buckets(total, 0.8)
    chunks = _chunked(docs, held_out, key, text, chunk_bytes)

    none = _table([], _ASK)
    counts, stats = _answered(_asked(chunks, 2, lambda c: _first(c, n)), "counts", np.ones(_COUNTS))
    told = [counts]
    asked = _with_answers(chunks, told, order, lambda c, a: _table(_second(c, a, n, order, least), _ASK), none, _ASK)
    contexts, more = _answered(asked, "contexts", Model.of(stats, least).pair_discount)
    told.append(contexts)
    model = Model.of(stats + more, least)
    if order > 2:
        asked = _with_answers(chunks, told, order, lambda c, a: _table(_third(c, a, n, least), _ASK), none, _ASK)
        told.append(_answered(asked, "weights", model.triple_discount)[0])
    unseen = unseen_mass(np.append(stats[0, 0], stats[0, 2:]), model.word_discount)
    return _with_answers(chunks, told, order, lambda c, a: _scored(c, a, model, unseen, order, n, result), result.empty_table(), schema)


# --- stored tables --------------------------------------------------------------------------------------------------

MODEL = "kind string, bucket int, hash long, n long, weight double"
#: Rows of a stored model's bucket, about.
MODEL_BUCKET_ROWS = 20_000_000
_EVENTS = "row long, w long, u long, pair long, before long, triple long"


def _events(rows: DataFrame) -> DataFrame:
    """Each token of each text as hashes: its word, the word before it and their pair; from a text's second token on, also the pair
    before it and the triple of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, "__text"):
            chunk = _Chunk.__new__(_Chunk)
            chunk.counts, hashes = _hashes(data, offsets)
            chunk.words, _, word = lookup.distinct(hashes)
            chunk.events(word, np.ones(len(word), bool), 3)
            before, triple = np.zeros((2, len(word)), np.uint64)
            before[chunk.inner] = chunk.pairs[chunk.triple_context][chunk.triple]
            triple[chunk.inner] = chunk.triple_hashes(np.arange(len(chunk.triple_counts)))[chunk.triple]
            first = np.ones(len(word), bool)
            first[chunk.inner] = False
            row = np.repeat(np.array(batch.column("__row").to_pylist(), np.int64), chunk.counts)
            columns = [hashes, np.append(chunk.words, _BEGIN)[chunk.before], chunk.pairs[chunk.pair]]
            arrays = [pa.array(row), *(pa.array(c.view(np.int64)) for c in columns), *(pa.array(c.view(np.int64), mask=first) for c in (before, triple))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "w", "u", "pair", "before", "triple"])

    return rows.select("__row", "__text").mapInArrow(run, _EVENTS)


def write(docs: DataFrame, held_out: Column, path: str, key: str = "doc_id", text: str = "text", least: int = LEAST_PAIR, bucket_rows: int = MODEL_BUCKET_ROWS) -> None:
    """Store the model of order 3 as one table partitioned by kind and bucket of hash: words (count, probability), retained pairs and
    triples (count, discounted share of their context), contexts of one word and of two (events, backoff weight), and one row for
    unseen words."""
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    train = docs.where(~F.coalesce(held_out, F.lit(False))).select(F.lit(0).cast("long").alias("__row"), F.coalesce(text, F.lit("")).alias("__text"))
    counted = scratch.stored(_events(train).groupBy("w", "u", "pair", "before", "triple").agg(F.count(F.lit(1)).alias("n")), "events")
    word = scratch.stored(counted.groupBy(F.col("w").alias("hash")).agg(F.sum("n").alias("n")), "words")
    pair = scratch.stored(counted.groupBy(F.col("pair").alias("hash")).agg(F.sum("n").alias("n"), F.first("u").alias("u"), F.first("w").alias("w")), "pairs")
    triple = scratch.stored(counted.where("triple is not null").groupBy(F.col("triple").alias("hash")).agg(F.sum("n").alias("n"), F.first("before").alias("u"), F.first("pair").alias("w")), "triples")
    stats = np.zeros((len(_STAT_ROWS), 2 + _COUNTS), np.int64)
    for level, table in enumerate((word, pair, triple)):
        low = [F.coalesce(F.sum((F.col("n") == r).cast("long")), F.lit(0)) for r in range(1, _COUNTS + 1)]
        stats[level] = list(table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *low).first())
    model = Model.of(stats, least)
    unseen = unseen_mass(np.append(stats[0, 0], stats[0, 2:]), model.word_discount)
    n = max(1, -(-int(stats[:, 1].sum()) // bucket_rows))

    def mass(discount: np.ndarray) -> Column:
        return F.col("n") * F.element_at(F.array(*[F.lit(float(x)) for x in [*discount, 1.0]]), (F.least("n", F.lit(DISCOUNTED + 1)) + 1).cast("int"))

    def above(events: DataFrame, lower: DataFrame, seen: DataFrame, discount: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """Events' discounted shares of their contexts, and the contexts' backoff weights. lower: the shares of the events without their first word."""
        held = events.where(F.col("n") >= least).withColumn("mass", mass(discount)).join(lower.select(F.col("hash").alias("w"), F.col("weight").alias("p")), "w")
        sums = held.groupBy(F.col("u").alias("hash")).agg(F.sum("mass").alias("mass"), F.sum("p").alias("p"))
        rest = F.col("n") - F.coalesce("mass", F.lit(0.0))
        more = (rest <= 1e-9 * F.col("n")).cast("int")
        weight = F.when(more == 1, F.lit(1.0)).otherwise(rest) / (F.col("n") + more) / F.greatest(1 - F.coalesce("p", F.lit(0.0)), F.lit(1e-300))
        contexts = seen.select("hash", "n").join(sums, "hash", "left").select("hash", "n", (F.col("n") + more).alias("base"), weight.alias("weight"))
        return held.join(contexts.select(F.col("hash").alias("u"), "base"), "u").select("hash", "n", (F.col("mass") / F.col("base")).alias("weight")), contexts

    words = word.withColumn("weight", mass(model.word_discount) / max(model.tokens + (unseen <= 0), 1))
    begin = word.where(F.col("hash") == int(_END.view(np.int64))).select(F.lit(int(_BEGIN.view(np.int64))).alias("hash"), "n")
    pairs, contexts = above(pair, words, word.unionByName(begin), model.pair_discount)
    pairs = scratch.stored(pairs, "shares")
    triples, pair_contexts = above(triple, pairs, pair, model.triple_discount)
    none = spark.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("n"), F.lit(model.left(unseen)).alias("weight"))
    kinds = {"word": words, "pair": pairs, "triple": triples, "context": contexts, "pair_context": pair_contexts, "unseen": none}
    every = None
    for kind, table in kinds.items():
        rows = table.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int").alias("bucket"), "hash", "n", "weight")
        every = rows if every is None else every.unionByName(rows)
    every.write.partitionBy("kind", "bucket").parquet(path)


def evaluate(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, score) of each row by a stored model, recursively token by token: the triple, else the weight of the two words
    before times the pair, else that of the one word before times the word, else times what unseen words have. For texts that are few
    beside the model; `score` does the same for whole corpora."""
    scratch.bound_batches(docs.sparkSession)
    model = docs.sparkSession.read.schema(MODEL).parquet(path)
    rows = scratch.stored(docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row")), "rows")
    told = _events(rows)
    for kind, on, name in (("triple", "triple", "p3"), ("pair_context", "before", "a2"), ("pair", "pair", "p2"), ("context", "u", "a1"), ("word", "w", "p1")):
        told = told.join(model.where(F.col("kind") == kind).select(F.col("hash").alias(on), F.col("weight").alias(name)), on, "left")
    left = F.lit(model.where("kind = 'unseen'").first()["weight"])
    one = F.lit(1.0)
    value = F.coalesce("p3", F.coalesce("a2", one) * F.coalesce("p2", F.coalesce("a1", one) * F.coalesce("p1", left)))
    sums = told.groupBy("row").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.log10(value)).alias("score"))
    return rows.join(sums, rows["__row"] == sums["row"]).select(key, "n_tokens", "score")
