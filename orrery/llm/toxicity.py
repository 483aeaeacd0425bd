"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and strengths of words of a lexicon learned from labelled rows (whole words, and stems: the
first bytes of longer words), the same after common disguises are undone, how close such words stand to second-person words, and rates of capitals, punctuation, repeated letters,
digits and disguised words. The trees boost the logistic loss over histograms of the features; out-of-fold scores are mapped to
probabilities by isotonic regression.

The lexicon is fitted on one half of a bounded sample of labelled rows and the trees on the other, so that the trees learn
how far the lexicon can be trusted on texts that it was not made from.

Defined cases: null and empty texts are scored from features that are all 0; labels that are null, or of rows that are not
there, teach nothing; where the labels have one value or none, every score is that value, or 0; repeated rows score alike, and
teach once; of an id with several texts each teaches; columns named like an output column are replaced.
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

#: Bounds of what is fitted: labelled rows (their texts are read whole), words of the lexicon.
SAMPLE_ROWS, LEXICON_WORDS = 20_000, 400
LEAST_TEXTS, LEAST_Z = 4, 3.5
NEAR = 5
#: Bytes of the stems that the lexicon tells apart.
STEMS = (5, 6, 7, 8, 9)
#: Second-person words (fixed values).
SECOND_PERSON = (
    "you your yours yourself u ur ya youre du dich dir dein deine deiner deinen ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os su sus"
).split()
#: What a character stands for in disguised words (fixed values).
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"}
NAMES = (
    "log_words", "lexicon_density", "lexicon_strength", "lexicon_best", "lexicon_distinct", "lexicon_count", "disguised_density", "disguised_count", "second_person_density",
    "near_second_person", "near_second_person_share", "capitals", "capital_words", "punctuation", "exclamations", "punctuation_runs", "symbols_inside", "mixed_digits",
    "letter_runs", "digits", "mean_word_length", "non_ascii",
)

_ALL = np.arange(256)
_UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_LETTER = _UPPER | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
_PUNCTUATION = (_ALL > 0x20) & (_ALL < 0x7F) & ~_LETTER & ~_DIGIT
_UNDISGUISE = tokens.LOWER.copy()
for _a, _b in DISGUISES.items():
    _UNDISGUISE[ord(_a)] = ord(_b)
_OUTER = _LETTER | _DIGIT


def _hash(words: Iterable[str]) -> np.ndarray:
    """Hashes of single words, as `Words.hashes` gives them."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    starts = ends - [len(r) for r in raw]
    return tokens.Words(data, np.array([0, len(data)]), starts, ends, np.array([0, len(raw)])).hashes()


def _keys(words: tokens.Words) -> list[np.ndarray]:
    """Hashes of the words and of their stems; 0 where a word has no such stem."""
    out = [words.hashes()]
    for k, n in enumerate(STEMS):
        long = words.end - words.start > n
        stem = tokens.Words(words.data, words.offsets, words.start, np.minimum(words.end, words.start + n), words.first)
        out.append(np.where(long, tokens.mix(stem.hashes() ^ np.uint64(0xA5A5A5A5 + k)), np.uint64(0)))
    return out


def _undisguised(raw: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens with disguises undone (outer punctuation off, look-alikes replaced, other symbols and repeats dropped),
    and which tokens that changed."""
    data = raw.data
    outer = _OUTER[data] | (data == ord("@")) | (data == ord("$"))
    owner = np.repeat(np.arange(len(raw.start)), raw.end - raw.start)
    place = np.repeat(raw.start, raw.end - raw.start) + tokens.within(raw.end - raw.start)
    inside = np.flatnonzero(outer[place])
    first, last = np.full(len(raw.start), -1), np.full(len(raw.start), -1)
    first[owner[inside[::-1]]] = place[inside[::-1]]
    last[owner[inside]] = place[inside]
    keep = (place >= first[owner]) & (place <= last[owner]) & (first[owner] >= 0)
    place, owner = place[keep], owner[keep]
    plain = tokens.LOWER[data[place]]
    letters = _UNDISGUISE[data[place]]
    word_has_letter = np.zeros(len(raw.start), bool)
    word_has_letter[owner[_LETTER[data[place]]]] = True
    letters = np.where(word_has_letter[owner], letters, plain)
    kept = _OUTER[letters]
    repeat = np.zeros(len(letters), bool)
    repeat[2:] = (letters[2:] == letters[1:-1]) & (letters[1:-1] == letters[:-2]) & (owner[2:] == owner[:-2])
    kept &= ~repeat
    changed = np.zeros(len(raw.start), bool)
    changed[owner[~kept | (letters != plain)]] = True
    counts = np.bincount(owner[kept], minlength=len(raw.start))
    ends = np.cumsum(counts)
    return tokens.Words(letters[kept], raw.offsets, ends - counts, ends, raw.first).hashes(), changed & word_has_letter


@dataclass
class Lexicon:
    """Sorted word hashes and how strongly each speaks for the label."""

    hashes: np.ndarray
    strengths: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's strength, 0 for others."""
        out = np.zeros(len(hashes))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.strengths[at], 0.0)
        return out

    def best(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's strength, the greatest of its own and its stems', and the hash that has it."""
        strength, which = self.of(keys[0]), keys[0]
        for k in keys[1:]:
            more = self.of(k)
            which = np.where(more > strength, k, which)
            strength = np.maximum(strength, more)
        return strength, which


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of features per text, in the order of NAMES."""
    words = tokens.split(data, offsets, tokens.ALPHANUMERIC, True)
    raw = tokens.split(data, offsets, tokens.NON_SPACE, False)
    n, m = np.maximum(words.counts, 1), np.maximum(raw.counts, 1)
    size = np.maximum(np.diff(offsets), 1)

    def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        return per_text(kind[data], offsets)

    hashes = words.hashes()
    strength, entry = lexicon.best(_keys(words))
    bad = np.flatnonzero(strength)
    text_of = words.text_of_word()
    best = np.zeros(len(n))
    np.maximum.at(best, text_of[bad], strength[bad])
    pairs = np.unique(np.stack([text_of[bad], np.searchsorted(lexicon.hashes, entry[bad])], axis=1), axis=0) if len(bad) else np.zeros((0, 2), int)
    distinct = np.bincount(pairs[:, 0], minlength=len(n)).astype(float)
    hits = np.bincount(text_of[bad], minlength=len(n)).astype(float)

    second = np.isin(hashes, np.sort(_hash(SECOND_PERSON)))
    you = np.flatnonzero(second)
    close = np.zeros(len(bad), bool)
    if len(you) and len(bad):
        after = np.minimum(np.searchsorted(you, bad), len(you) - 1)
        for at in (you[after], you[np.maximum(after - 1, 0)]):
            close |= (abs(at - bad) <= NEAR) & (text_of[at] == text_of[bad])
    near = np.bincount(text_of[bad[close]], minlength=len(n)).astype(float)

    undone, changed = _undisguised(raw)
    disguised = per_text((lexicon.of(undone) > 0) & changed, raw.first)

    length = raw.end - raw.start
    token_sum = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[data])])[np.stack([raw.start, raw.end])], axis=0)[0]
    capitals, digits, letters = map(token_sum, (_UPPER, _DIGIT, _LETTER))
    symbol_inside = np.zeros(len(data), bool)
    if len(data) > 2:
        symbol_inside[1:-1] = _PUNCTUATION[data][1:-1] & _LETTER[data][:-2] & _LETTER[data][2:]
    run = np.zeros(len(data), bool)
    letter_run = np.zeros(len(data), bool)
    if len(data) > 2:
        low = tokens.LOWER[data]
        same = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
        letter_run[2:] = same & _LETTER[data][2:] & (data[2:] < 0x80)
        run[1:] = _PUNCTUATION[data][1:] & _PUNCTUATION[data][:-1]
    shouts = np.isin(_ALL, [ord("!"), ord("?")])
    columns = [
        np.log1p(words.counts), hits / n, per_text(strength, words.first) / n, best, distinct, np.log1p(hits), disguised / m, np.log1p(disguised),
        per_text(second, words.first) / n, near / n, near / np.maximum(hits, 1), bytes_of(_UPPER) / size, per_text((capitals >= 2) & (capitals == letters), raw.first) / m,
        bytes_of(_PUNCTUATION) / size, bytes_of(shouts) / size, per_text(run, offsets) / size, per_text(symbol_inside, offsets) / m, per_text((digits > 0) & (letters > 0), raw.first) / m,
        per_text(letter_run, offsets) / size, bytes_of(_DIGIT) / size, per_text(length, raw.first) / m, bytes_of(_ALL >= 0x80) / size,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Boosted trees of a fixed depth over binned features: at level l, node j splits on feature[l][j] at bin cut[l][j]."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self._margins(self.bins(x))

    def _margins(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(b), np.int64)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (b[rows, f[node]] > c[node])
            out += leaf[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaves and histogram splits."""
    edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, bins - 1))) for c in x.T]
    edges = [np.unique(np.concatenate([e, [np.nextafter(0, 1)]])) for e in edges]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    out = Trees(edges, float(np.log(share / (1 - share))), [])
    b = out.bins(x)
    wide, width = x.shape[1], max(len(e) for e in edges) + 1
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        features_, cuts = [], []
        for level in range(depth):
            nodes = 1 << level
            sums = np.zeros((2, wide, nodes, width))
            for k in range(wide):
                key = node * width + b[:, k]
                sums[0, k] = np.bincount(key, g, nodes * width).reshape(nodes, width)
                sums[1, k] = np.bincount(key, h, nodes * width).reshape(nodes, width)
            left = np.cumsum(sums, axis=3)[..., :-1]
            whole = sums.sum(axis=3, keepdims=True)
            right = whole - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[1] < least * 0.05) | (right[1] < least * 0.05)] = -1
            flat = gain.transpose(1, 0, 2).reshape(nodes, -1)
            pick = flat.argmax(axis=1)
            f, c = pick // (width - 1), pick % (width - 1)
            c = np.where(flat[np.arange(nodes), pick] > 1e-6, c, width)
            features_.append(f)
            cuts.append(c)
            node = 2 * node + (b[np.arange(len(y)), f[node]] > c[node])
        leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
        out.trees.append((features_, cuts, leaf))
        margin += leaf[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: points between which to interpolate."""
    points, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place).astype(float)
    blocks: list[list[float]] = []
    for s, v, w in zip(points.tolist(), (np.bincount(place, y) / weight).tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[3]
    xs = [e for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [e for b in blocks for e in ((b[0], b[0]) if b[3] > b[2] else (b[0],))]
    return np.array(xs), np.array(ys)


@dataclass
class Scorer:
    """A fitted model; without trees, one score for every text."""

    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray]
    constant: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.constant)
        return np.clip(np.interp(self.trees.margins(features(data, offsets, self.lexicon)), *self.points), 0, 1)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled rows, chosen by a hash of their ids and texts, whole and stored; `half` deals them in two."""
    some = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("int").alias("y"))
    some = scratch.sample(some, rows, "__k")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    labelled = texts.join(F.broadcast(some), "__k")
    drawn = scratch.sample(labelled.select("h").distinct(), rows, "h")
    kept = labelled.join(F.broadcast(drawn), "h").groupBy("h").agg(F.first("t").alias("t"), F.first("y").alias("y"), F.first("__k").alias("k"))
    return scratch.stored(kept.select("t", "y", F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(2)).alias("half")), "labelled")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer from at most `rows` labelled rows. ``docs`` and ``labels`` must hold only rows that it may learn from."""
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    sample = _sample(docs, labels, key, text, label, rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, "t"):
            words = tokens.split(data, offsets, tokens.ALPHANUMERIC, True)
            y = np.array(batch.column("y").to_pylist(), np.int64)
            keys = np.concatenate(_keys(words))
            text_of = np.tile(words.text_of_word(), 1 + len(STEMS))
            order = np.lexsort((text_of, keys))
            keys, text_of = keys[order], text_of[order]
            new = keys != 0
            new[1:] &= (keys[1:] != keys[:-1]) | (text_of[1:] != text_of[:-1])
            hashes, back = np.unique(keys[new], return_inverse=True)
            mine = y[text_of[new]]
            ones = np.bincount(back, mine, len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ones), pa.array(np.bincount(back, minlength=len(hashes)).astype(np.int64) - ones)], names=["h", "ones", "zeros"])

    first = sample.where("half = 0")
    totals = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, zero = totals.get(1, 0), totals.get(0, 0)
    counted = first.select("t", "y").mapInArrow(count, "h long, ones long, zeros long").groupBy("h").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).where(F.col("a") >= LEAST_TEXTS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (one + 1.0)) - F.log(b / (zero + 1.0))
    found = counted.withColumns({"s": odds, "z": odds / F.sqrt(1 / a + 1 / b)}).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(LEXICON_WORDS).collect()
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], np.array([r["s"] for r in found], float)[order])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, "t"):
            x = features(data, offsets, lexicon)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    seen = sample.where("half = 1").select("t", "y").mapInArrow(measure, "x array<double>, y int").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    none = (np.zeros(1), np.zeros(1))
    if len(set(y)) < 2:
        return Scorer(lexicon, None, none, float(y[0]) if len(y) else float(one > 0 and zero == 0))
    x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    fold = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        out[fold == k] = boost(x[fold != k], y[fold != k]).margins(x[fold == k])
    return Scorer(lexicon, boost(x, y), isotonic(out, y))


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from a score of 0.5)."""
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, text):
            s = shared.value.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema)
