"""Benchmark decontamination: training words are streamed through a generalised suffix automaton of the test items.

The automaton tracks, word by word, the longest run of words that ends there and occurs in any item. Wherever that length
reaches the window, the last `window` words are a window of an item and are hit; an item shorter than the window counts as
one window of its own. Runs whose neighbouring pairs of words occur in no item cannot be longer than one word, so the
automaton is only entered where they do.

Words are runs of digits, letters and bytes beyond ASCII, with A-Z lower-cased. Items are taken to the workers in automata of
at most `AUTOMATON_BYTES` of item text each (a longer single item has one of its own). A benchmark of several automata is one stored pass over
the training texts for each: an automaton is built, broadcast, used and destroyed before the next is built, so that memory has a fixed bound
whatever the size of the benchmark.

Defined cases: null and empty texts have no words; an item without words never occurs; items with equal ids count once, and
items with a null id hit words but are not named or counted; without items nothing is hit; repeated training rows are
judged each by itself; columns of the input stay as they are (new ones replace those of the same name).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, tokens

AUTOMATON_BYTES = 8 << 20
_HIT, _SEEN, _CUT = "__hit", "__seen", "__cut"


class Automaton:
    """All substrings of some sequences of words, by states; `link` is the state of the longest suffix in another state.

    Most states have one way on and belong to one item: these stand in arrays of four bytes a state, and only further ways and items in
    dictionaries.
    """

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        numbers = [np.searchsorted(self.vocabulary, h).astype(np.int32) for _, h in items]
        self.word, self.to, self.link, self.length = array("i"), array("i"), array("i"), array("i")
        self.ways: dict[int, dict[int, int]] = {}
        self._add(0, -1)
        for sequence in numbers:
            last = 0
            for word in sequence.tolist():
                last = self._extend(last, word)
        self.window = window
        self.ids = [i for i, _ in items]
        whole: dict[int, list[tuple[int, int]]] = {}
        self.item, self.others = array("i", [-1]) * len(self.link), {}
        shortest = window
        for k, sequence in enumerate(numbers):
            state = 0
            for word in sequence.tolist():
                state = self.next(state, word)
                if len(sequence) >= window and self.length[state] >= window:
                    self._belongs(self._holding(state, window), k)
            if 0 < len(sequence) < window:
                shortest = min(shortest, len(sequence))
                whole.setdefault(self._holding(state, len(sequence)), []).append((len(sequence), k))
        self.shortest = shortest
        order = np.argsort(np.array(self.length), kind="stable")
        self.at_window = array("i", [0]) * len(self.link)
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for state in order[1:].tolist():
            up = self.link[state]
            self.at_window[state] = self.at_window[up] or (state if self.length[state] >= window else 0)
            if mine := whole.get(state, []) + self.whole.get(up, []):
                self.whole[state] = mine
        pairs = [s[:-1].astype(np.int64) * len(self.vocabulary) + s[1:] for s in numbers if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def next(self, state: int, word: int) -> int:
        """The state that a word leads to, -1 for none."""
        if self.word[state] == word:
            return self.to[state]
        ways = self.ways.get(state)
        return -1 if ways is None else ways.get(word, -1)

    def _lead(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, target
        else:
            self.ways.setdefault(state, {})[word] = target

    def _belongs(self, state: int, item: int) -> None:
        if self.item[state] in (-1, item):
            self.item[state] = item
        else:
            self.others.setdefault(state, set()).add(item)

    def _holding(self, state: int, length: int) -> int:
        """The state, on the way up from `state`, of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _add(self, length: int, link: int, like: int = -1) -> int:
        """A new state, with the ways on of another."""
        state = len(self.link)
        self.word.append(self.word[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else -1)
        if like in self.ways:
            self.ways[state] = dict(self.ways[like])
        self.length.append(length)
        self.link.append(link)
        return state

    def _split(self, parent: int, word: int, child: int) -> int:
        """`child` is reached by longer sequences too: part those that end in `parent` and `word` from them."""
        copy = self._add(self.length[parent] + 1, self.link[child], child)
        self.link[child] = copy
        while parent >= 0 and self.next(parent, word) == child:
            self._lead(parent, word, copy)
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next(last, word)
        if known >= 0:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._add(self.length[last] + 1, 0)
        at = last
        while at >= 0 and self.next(at, word) < 0:
            self._lead(at, word, state)
            at = self.link[at]
        if at >= 0:
            child = self.next(at, word)
            self.link[state] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return state

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the items' vocabulary, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.likely[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out

    def runs(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of words between which every pair of neighbours occurs in an item, if long enough to matter."""
        known = numbers >= 0
        linked = np.zeros(len(numbers) + 1, bool)
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            key = numbers[both - 1] * len(self.vocabulary) + numbers[both]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[both[self.pairs[at] == key]] = True
        linked[first] = False
        starts = np.flatnonzero(known & ~linked[:-1])
        stops = np.flatnonzero(known & ~linked[1:]) + 1
        long = stops - starts >= self.shortest
        return zip(starts[long].tolist(), stops[long].tolist(), strict=True)

    def matched(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each word the place, the state and the length of the longest match that ends there."""
        state = length = 0
        following, link, lengths = self.next, self.link, self.length
        for place, word in enumerate(words):
            while (to := following(state, word)) < 0 and state:
                state = link[state]
                length = lengths[state]
            if to >= 0:
                state, length = to, length + 1
            yield place, state, length

    def scan(self, hashes: np.ndarray, first: np.ndarray, hit: np.ndarray, seen: list[set[str | None]]) -> None:
        """Mark words inside occurrences, and add each text's items."""
        numbers = self.numbers(hashes)
        for start, stop in self.runs(numbers, first):
            text = int(np.searchsorted(first, start, "right")) - 1
            for place, state, length in self.matched(numbers[start:stop].tolist()):
                if length >= self.window:
                    hit[start + place - self.window + 1 : start + place + 1] = True
                    own = self.at_window[state]
                    seen[text].add(self.ids[self.item[own]])
                    seen[text].update(self.ids[k] for k in self.others.get(own, ()))
                for size, k in self.whole.get(state, ()):
                    if size <= length:
                        hit[start + place - size + 1 : start + place + 1] = True
                        seen[text].add(self.ids[k])


def _automata(items: DataFrame, item_key: str, item_text: str, window: int, most: int) -> Iterator[Automaton]:
    """Automata of all the items, each of at most so many bytes of text (one item at least)."""
    held: list[tuple[str | None, bytes]] = []
    size = 0

    def build() -> Automaton:
        data = np.frombuffer(b"".join(t for _, t in held), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in held])]).astype(np.int64)
        words = tokens.split(data, offsets, tokens.ALPHANUMERIC, True)
        hashes = words.hashes()
        return Automaton([(k, hashes[a:b]) for (k, _), a, b in zip(held, words.first[:-1], words.first[1:], strict=True)], window)

    for row in items.select(F.col(item_key).cast("string"), F.col(item_text).cast("binary")).where(F.col(item_text).isNotNull()).distinct().toLocalIterator():
        if held and size + len(row[1]) > most:
            yield build()
            held, size = [], 0
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield build()


#: Makes a batch's rows from its words, which of them are hit, the items seen, and the automaton if there is only one.
Finish = Callable[[pa.RecordBatch, tokens.Words, np.ndarray, list[set[str | None]], Automaton | None], pa.RecordBatch]


def _several(items: DataFrame, item_text: str, most: int) -> bool:
    """Whether items may need more than one automaton."""
    return (items.agg(F.sum(F.octet_length(item_text)).alias("b")).first()["b"] or 0) > most


def _pass(docs: DataFrame, text: str, shared: Broadcast | None, finish: Finish | None, schema: T.StructType) -> DataFrame:
    """Scans with an automaton, if there is one; marks of earlier scans are taken up. Without `finish` marks are handed on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared is not None else None
        for batch, data, offsets in tokens.slices(batches, text):
            words = tokens.split(data, offsets, tokens.ALPHANUMERIC, True)
            hit = np.zeros(len(words.start), bool)
            seen: list[set[str | None]] = [set() for _ in words.counts]
            if _HIT in batch.schema.names:
                hit |= np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(batch.column(_HIT).to_pylist(), words.counts, strict=True)])
                for s, more in zip(seen, batch.column(_SEEN).to_pylist(), strict=True):
                    s.update(more)
            if own is not None:
                own.scan(words.hashes(), words.first, hit, seen)
            batch = batch.select([c for c in batch.schema.names if c not in (_HIT, _SEEN)])
            if finish is not None:
                yield finish(batch, words, hit, seen, own)
            else:
                marks = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                columns = [*batch.columns, pa.array(marks, pa.binary()), pa.array([list(s) for s in seen], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, _HIT, _SEEN])

    return docs.mapInArrow(run, schema)


def _passes(docs: DataFrame, text: str, automata: Iterator[Automaton], several: bool, finish: Finish, schema: T.StructType) -> DataFrame:
    """The rows that `finish` makes once all automata have scanned. One automaton is one pass; of several each pass is stored before the next."""
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    if not several:
        return _pass(docs, text, spark.sparkContext.broadcast(next(automata)), finish, schema)
    carried = T.StructType([*docs.schema.fields, T.StructField(_HIT, T.BinaryType()), T.StructField(_SEEN, T.ArrayType(T.StringType()))])
    before = None
    for automaton in automata:
        shared = spark.sparkContext.broadcast(automaton)
        docs, path = scratch.stored_at(_pass(docs, text, shared, None, carried), "marked")
        shared.destroy()
        if before is not None:
            scratch.remove(spark, before)
        before = path
    return _pass(docs, text, None, finish, schema)


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per training row: key, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean").fields])

    def finish(batch: pa.RecordBatch, words: tokens.Words, hit: np.ndarray, seen: list[set[str | None]], own: Automaton | None) -> pa.RecordBatch:
        hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
        names = [sorted(s - {None}) for s in seen]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        columns = [batch.column(key), pa.array(words.counts), pa.array(hits), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(digests), pa.array(hits > 0)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    automata = _automata(items, item_key, item_text, window, automaton_bytes)
    return _passes(docs, text, automata, _several(items, item_text, automaton_bytes), finish, schema)


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without each run of hit words, from the first word's beginning to the last one's end, and a line break there."""
    raw = text.encode()
    words = tokens.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tokens.ALPHANUMERIC, True)
    mine = np.concatenate([[False], hit, [False]])
    out, at = [], 0
    for i, j in zip(np.flatnonzero(mine[1:] & ~mine[:-1]), np.flatnonzero(~mine[1:] & mine[:-1]), strict=True):
        out.append(raw[at : words.start[i]])
        at = words.end[j - 1]
    return b"\n".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, most_coverage: float = 0.5, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` without the spans of hit words; a row of whose words a larger share than `most_coverage` is hit goes as a whole.

    What a span held between its first and last word goes with it, and a line break takes its place. Texts without a hit, and
    null texts, stay byte for byte. Where the words on both sides of a cut spell a window again, that goes too;
    where the benchmark needs several automata, the rows that were cut are stored and pass through all of them until none is cut.
    """
    several = _several(items, item_text, automaton_bytes)
    automata = lambda: _automata(items, item_key, item_text, window, automaton_bytes)

    def marked(batch: pa.RecordBatch, cut: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut)], names=[*batch.schema.names, _CUT]) if several else batch

    def finish(batch: pa.RecordBatch, words: tokens.Words, hit: np.ndarray, seen: list[set[str | None]], own: Automaton | None) -> pa.RecordBatch:
        place = batch.schema.get_field_index(text)
        hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
        if not hits.any():
            return marked(batch, np.zeros(batch.num_rows, bool))
        texts = batch.column(place).to_pylist()
        keep = hits <= most_coverage * words.counts
        for k in np.flatnonzero((hits > 0) & keep):
            mine = hit[words.first[k] : words.first[k + 1]]
            while mine.any() and mine.sum() <= most_coverage * len(mine):
                texts[k] = _cut(texts[k], mine)
                if several:
                    mine = np.zeros(0, bool)
                    break
                raw = np.frombuffer(texts[k].encode(), np.uint8)
                again = tokens.split(raw, np.array([0, len(raw)]), tokens.ALPHANUMERIC, True)
                mine = np.zeros(len(again.start), bool)
                own.scan(again.hashes(), again.first, mine, [set()])
            keep[k] = not mine.any()
        columns = list(batch.columns)
        columns[place] = pa.array(texts, columns[place].type)
        return marked(pa.RecordBatch.from_arrays(columns, schema=batch.schema), hits > 0).filter(pa.array(keep))

    if not several:
        return _passes(docs, text, automata(), False, finish, docs.schema)
    schema = T.StructType([*docs.schema.fields, T.StructField(_CUT, T.BooleanType())])
    out, left = None, docs
    while out is None or not left.isEmpty():
        passed = scratch.stored(_passes(left, text, automata(), True, finish, schema), "decontaminated")
        done, left = passed.where(~F.col(_CUT)).drop(_CUT), passed.where(_CUT).drop(_CUT)
        out = done if out is None else out.unionByName(done)
    return out
