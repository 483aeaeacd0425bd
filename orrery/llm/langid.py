"""Language identification by a linear-chain conditional random field over words.

Each word has features: its byte n-grams of 2 to 4 bytes with marks at both ends (so prefixes and suffixes are among
them), itself, and the languages in whose learned lexicon it stands. A word's emission scores are sums of its features'
weights; learned transitions tie neighbours together. Forward-backward gives each word's posterior over languages, so that
code-switched text gets a label per word; a document's language is that with the greatest mean posterior.

Words are runs of digits, letters and bytes beyond ASCII; a run of more than `WORD_BYTES` is cut into words of about that size, between
characters, so that a language written without spaces has words and pieces like any other.

Weights are fitted on a bounded sample of pieces of 24 words of the labelled texts, the same number for each language, on sequences that join
stretches of different lengths and languages. Every piece of every labelled text of a language, however long, is as likely to be drawn.
Long texts are run through in lanes of words whose transfer matrices are composed: exact, and in few steps.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row every text is `und`;
rows with a null language teach nothing; every language with a word is learnt; pieces that repeat are drawn once, and repeated rows
are predicted alike; columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, tokens

#: The bound of the sample that the weights are fitted on, pieces of all languages together, and bytes after which a word is cut.
SAMPLE_PIECES, WORD_BYTES = 48_000, 64
DIMENSIONS = 1 << 17
GRAMS = (2, 3, 4)
LEXICON_WORDS = 300
LANE = 256
UNKNOWN = "und"
_SLICE = 2 << 20
#: Words whose features are held at a time.
_WORDS = 16_384
#: Ranges of hashes that drawn pieces are counted by.
_RANGES = 1024
_PIECE, _SEQUENCES, _BATCH, _EPOCHS = 24, 6144, 256, 3
#: Words of a training sequence, and the fewest of a stretch in one language (of a longer piece).
_LENGTH, _STRETCH = 48, 4


def _split(data: np.ndarray, offsets: np.ndarray) -> tokens.Words:
    """Words of the texts, those of more than `WORD_BYTES` cut between characters after about as many bytes."""
    words = tokens.split(data, offsets, tokens.ALPHANUMERIC, True)
    parts = -(-(words.end - words.start) // WORD_BYTES)
    if not len(parts) or parts.max() == 1:
        return words
    step = tokens.within(parts)
    start, inner = np.repeat(words.start, parts) + WORD_BYTES * step, step > 0
    for _ in range(3):  # a character has at most three bytes after its first
        start -= inner & ((words.data[start] & 0xC0) == 0x80)
    end = np.append(start[1:], 0)
    last = np.cumsum(parts) - 1
    end[last] = words.end
    return tokens.Words(words.data, words.offsets, start, end, np.searchsorted(start, words.offsets))


def _features(words: tokens.Words, which: np.ndarray, hashes: np.ndarray, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the given words, one word's after another's, and where each word's begin."""
    start, length = words.start[which], words.end[which] - words.start[which]
    padded = length + 2
    at = np.cumsum(padded) - padded
    text = np.zeros(int(padded.sum()) + max(GRAMS), np.uint32)
    step = tokens.within(length)
    text[np.repeat(at + 1, length) + step] = words.data[np.repeat(start, length) + step]
    text[at], text[at + length + 1] = 2, 3
    parts, owner = [(hashes[which] % np.uint64(DIMENSIONS)).astype(np.int64)], [np.arange(len(which))]
    for n in GRAMS:
        counts = np.maximum(padded - n + 1, 0)
        place = np.repeat(at, counts) + tokens.within(counts)
        key = np.full(len(place), n, np.uint64)
        for i in range(n):
            key = (key << np.uint64(8)) | text[place + i].astype(np.uint64)
        parts.append((tokens.mix(key) % np.uint64(DIMENSIONS)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(which)), counts))
    for k, lexicon in enumerate(lexicons):
        found = np.flatnonzero(np.isin(hashes[which], lexicon))
        parts.append(np.full(len(found), DIMENSIONS + k))
        owner.append(found)
    owned = np.concatenate(owner)
    order = np.argsort(owned, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owned[order], np.arange(len(which)))


@dataclass
class Chain:
    """A fitted field: weights by feature and language, the score of each step between languages, and of each beginning."""

    languages: list[str]
    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray
    lexicons: list[np.ndarray]

    def emissions(self, words: tokens.Words) -> np.ndarray:
        """Each word's scores, computed once for equal words."""
        hashes = words.hashes()
        if not len(hashes):
            return np.zeros((0, len(self.languages)))
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.empty((len(first), len(self.languages)), np.float32)
        for i in range(0, len(first), _WORDS):
            numbers, begin = _features(words, first[i : i + _WORDS], hashes, self.lexicons)
            out[i : i + _WORDS] = np.add.reduceat(self.weights[numbers], begin, axis=0)
        return out[back].astype(np.float64)

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's posterior over languages, by forward-backward in lanes; rows first[k]:first[k + 1] are one chain."""
        counts = np.diff(first)
        lanes = -(-counts // LANE)
        begin = np.repeat(first[:-1], lanes) + LANE * tokens.within(lanes)
        size = np.minimum(LANE, np.repeat(first[1:], lanes) - begin)
        number = len(self.languages)
        if not len(begin):
            return np.zeros((0, number))
        weight = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.steps - self.steps.max())
        order = np.argsort(-size, kind="stable")
        active = [int(np.searchsorted(-size[order], -t, "left")) for t in range(int(size.max()))]
        at = begin[order]

        through = np.zeros((len(at), number, number))
        through[:, range(number), range(number)] = weight[at]
        for t, n in enumerate(active[1:], 1):
            x = (through[:n] @ step) * weight[at[:n] + t][:, None, :]
            through[:n] = x / x.max(axis=(1, 2), keepdims=True)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))

        into, out = np.empty((len(at), number)), np.ones((len(at), number))
        lane_first = np.concatenate([[0], np.cumsum(lanes)])
        full = np.flatnonzero(lanes)
        into[place[lane_first[:-1][full]]] = np.exp(self.begin - self.begin.max())
        for k in range(1, int(lanes.max())):
            own = np.flatnonzero(lanes > k)
            before, here = place[lane_first[own] + k - 1], place[lane_first[own] + k]
            x = np.einsum("ni,nij->nj", into[before], through[before]) @ step
            into[here] = x / x.sum(axis=1, keepdims=True)
        for k in range(int(lanes.max()) - 1, 0, -1):
            own = np.flatnonzero(lanes > k)
            before, here = place[lane_first[own] + k - 1], place[lane_first[own] + k]
            x = np.einsum("nij,nj->ni", through[here], out[here]) @ step.T
            out[before] = x / x.sum(axis=1, keepdims=True)

        result = np.empty_like(weight)
        forward = into
        for t, n in enumerate(active):
            x = (forward[:n] if t == 0 else forward[:n] @ step) * weight[at[:n] + t]
            forward = x / x.sum(axis=1, keepdims=True)
            result[at[:n] + t] = forward
        backward = out
        ends = size[order]
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            inner = ends[:n] > t + 1
            if inner.any():
                own = np.flatnonzero(inner)
                x = (weight[at[own] + t + 1] * backward[own]) @ step.T
                backward[own] = x / x.sum(axis=1, keepdims=True)
            result[at[:n] + t] *= backward[:n]
        return result / result.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Chain | None:
    """A chain from labelled texts; None without any word."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    words = _split(data, offsets)
    languages = sorted(set(labels))
    number = len(languages)
    if not len(words.start):
        return None
    label = np.array([languages.index(x) for x in labels])
    hashes = words.hashes()
    of_word = label[words.text_of_word()]
    unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.zeros((len(unique), number))
    np.add.at(counts, (back, of_word), 1)
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 1))
    gain = counts * (share - np.log((counts.sum(axis=1, keepdims=True) - counts + 0.5) / (counts.sum() - counts.sum(axis=0) + 1)))
    lexicons = [np.sort(unique[np.argsort(-gain[:, k])[:LEXICON_WORDS]]) for k in range(number)]
    parts = [_features(words, first[i : i + _WORDS], hashes, lexicons) for i in range(0, len(first), _WORDS)]
    before = np.cumsum([0] + [len(n) for n, _ in parts])
    numbers, begin = np.concatenate([n for n, _ in parts]), np.concatenate([b + at for (_, b), at in zip(parts, before, strict=False)])
    ends = np.append(begin[1:], len(numbers))

    rng = np.random.default_rng(seed)
    firsts = [words.first[:-1][(words.counts > 0) & (label == k)] for k in range(number)]
    usable, stop = [k for k in range(number) if len(firsts[k])], dict(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))
    length = _LENGTH
    index = np.empty((_SEQUENCES, length), np.int64)
    for row in index:
        at = 0
        while at < length:
            own = firsts[usable[rng.integers(len(usable))]]
            a = int(own[rng.integers(len(own))])
            n = min(int(rng.integers(_STRETCH, _PIECE + 1)), stop[a] - a, length - at)
            row[at : at + n] = np.arange(a, a + n)
            at += n
    truth, word = of_word[index], back[index]

    weights = np.zeros((DIMENSIONS + number, number))
    steps, start = np.zeros((number, number)), np.zeros(number)
    seen = [np.full(x.shape, 1e-2) for x in (weights, steps, start)]
    for epoch in range(_EPOCHS):
        for at in range(0, _SEQUENCES, _BATCH):
            own, y = word[at : at + _BATCH], truth[at : at + _BATCH]
            distinct, inverse = np.unique(own, return_inverse=True)
            spread = np.repeat(begin[distinct], ends[distinct] - begin[distinct]) + tokens.within(ends[distinct] - begin[distinct])
            used, cut = numbers[spread], np.cumsum(ends[distinct] - begin[distinct]) - (ends[distinct] - begin[distinct])
            scores = np.add.reduceat(weights[used], cut, axis=0)[inverse.reshape(own.shape)]
            n = len(own)
            forward, backward = np.empty(scores.shape), np.zeros(scores.shape)
            forward[:, 0] = start + scores[:, 0]
            for t in range(1, length):
                forward[:, t] = _log_sum(forward[:, t - 1, :, None] + steps, 1) + scores[:, t]
            for t in range(length - 2, -1, -1):
                backward[:, t] = _log_sum(steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            total = _log_sum(forward[:, -1], 1)
            slope = np.exp(forward + backward - total[:, None, None])
            slope[np.arange(n)[:, None], np.arange(length), y] -= 1
            pair = np.exp(forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
            np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
            per_word = np.zeros((len(distinct), number))
            np.add.at(per_word, inverse.reshape(-1), slope.reshape(-1, number))
            sized = np.repeat(per_word, ends[distinct] - begin[distinct], axis=0) / n
            change = np.stack([np.bincount(used, sized[:, k], len(weights)) for k in range(number)], axis=1)
            for x, g, s in ((weights, change, seen[0]), (steps, pair / n + 1e-3 * steps, seen[1]), (start, slope[:, 0].sum(axis=0) / n, seen[2])):
                s += g * g
                x -= 0.3 * g / np.sqrt(s)
    return Chain(languages, weights.astype(np.float32), steps, start, lexicons)


def _pieces(docs: DataFrame, text: str, language: str, most: int) -> list[tuple[str, str]]:
    """Pieces of labelled texts with their languages: of each language those of least hashes, `most` in all at most.

    Only pieces below a share of all hashes are drawn. A language's bytes tell how many pieces it has at least, and so a share that some more
    than its number of pieces fall below; words are mostly shorter, and then several times as many do. Counts of the drawn pieces by ranges of
    their hashes then tell up to which range they are needed, so that no language's pieces are sorted in one task.
    """
    usable = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(language).alias("l"))
    sizes = {r["l"]: r["b"] // (_PIECE * (WORD_BYTES + 3)) + 1 for r in usable.groupBy("l").agg(F.sum(F.octet_length("t")).alias("b")).collect()}
    if not sizes:
        return []
    each = max(1, most // len(sizes))
    bound = {k: min(1.0, 1.2 * each / n) * 2.0**64 for k, n in sizes.items()}
    scratch.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, "t", _SLICE):
            words = _split(data, offsets)
            if not len(words.start):
                continue
            counts = -(-words.counts // _PIECE)
            first = np.repeat(words.first[:-1], counts) + _PIECE * tokens.within(counts)
            stop = np.minimum(first + _PIECE, np.repeat(words.first[1:], counts))
            hashes = tokens.spans(words.hashes(), first, stop)
            labels = batch.column("l").to_pylist()
            below = np.repeat(np.array([bound[x] for x in labels]), counts)
            at = np.flatnonzero(hashes.astype(float) < below)
            owner = np.repeat(np.arange(len(labels)), counts)[at]
            texts = [words.data[i:j].tobytes().decode() for i, j in zip(words.start[first][at], words.end[stop - 1][at], strict=True)]
            place = (hashes[at].astype(float) / below[at] * _RANGES).astype(np.int32)
            columns = [pa.array([labels[k] for k in owner], pa.string()), pa.array(hashes[at].view(np.int64)), pa.array(place), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["l", "h", "place", "t"])

    drawn = scratch.stored(usable.mapInArrow(run, "l string, h long, place int, t string").dropDuplicates(["l", "h"]), "pieces")
    held, last = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, -1)
    for r in sorted(drawn.groupBy("l", "place").count().collect()):
        if held[r["l"]] < each:
            held[r["l"]], last[r["l"]] = held[r["l"]] + r["count"], r["place"]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(list(last.items()), "l string, last int"))
    out: list[tuple[str, str]] = []
    kept = dict.fromkeys(sizes, 0)
    for r in sorted(drawn.join(bounds, "l").where("place <= last").select("l", "place", "h", "t").collect()):
        kept[r["l"]] += 1
        if kept[r["l"]] <= each:
            out.append((r["t"], r["l"]))
    return out


def train(docs: DataFrame, text: str = "text", language: str = "lang", pieces: int = SAMPLE_PIECES) -> Chain | None:
    """A chain from at most `pieces` pieces of the labelled texts, as many of each language, chosen by a hash of their words."""
    sample = _pieces(docs, text, language, pieces)
    return fit([t for t, _ in sample], [x for _, x in sample]) if sample else None


def predict(docs: DataFrame, chain: Chain | None, text: str = "text", spans: bool = False, word_score: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (the mean posterior of that language); with spans, runs of words by label too.

    With word_score, also that: the mean posterior of each word's own label, which is high for a text that is surely mixed.
    A span has lang, first_word and n_words.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    new = T._parse_datatype_string("lang_pred string, score double" + ", lang_spans array<struct<lang:string,first_word:int,n_words:int>>" * spans + ", word_score double" * word_score)
    kept = docs.drop(*new.names)
    passed = kept.columns
    schema = T.StructType([*kept.schema.fields, *new.fields])
    shared = spark.sparkContext.broadcast(chain)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, offsets in tokens.slices(batches, text, _SLICE):
            letter = np.array(batch.column("__letter").to_pylist(), bool)
            batch = batch.select(passed)
            words = _split(data, offsets)
            if own is None:
                letter[:] = False
            known = letter & (words.counts > 0)
            names, scores = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter))
            sure = np.zeros(len(letter))
            marks: list[list | None] = [[] for _ in letter]
            if known.any():
                each = own.posteriors(own.emissions(words), words.first)
                sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
                mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.counts, 1)[:, None]
                best = mean.argmax(axis=1)
                names[known] = np.array(own.languages, object)[best[known]]
                scores[known] = np.clip(mean[np.arange(len(best)), best][known], 0, 1)
                tops = np.concatenate([[0.0], np.cumsum(each.max(axis=1))])
                sure[known] = np.clip((tops[words.first[1:]] - tops[words.first[:-1]])[known] / words.counts[known], 0, 1)
                if spans:
                    top = each.argmax(axis=1)
                    for k in np.flatnonzero(known):
                        run_of = top[words.first[k] : words.first[k + 1]]
                        cuts = np.append(np.flatnonzero(np.diff(run_of, prepend=-1)), len(run_of))
                        marks[k] = [{"lang": own.languages[run_of[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [*batch.columns, pa.array(list(names), pa.string()), pa.array(scores)]
            columns += [pa.array(marks, span_type)] * spans + [pa.array(sure)] * word_score
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
