"""Byte-level BPE encoding and decoding from a file of ranks, in time linear in the text.

A text is cut by the tokenizer's pattern; each piece is encoded by itself. Bytes are mapped to Latin-1 characters, so that pyahocorasick's trie of
the tokens finds the longest token that begins at a byte. The encoder takes the longest token at each place that may stand beside the token
before it; if none may, it goes back a token and takes the next shorter one. A place from which no way led on is never tried again, since the
encoding of what lies before a place is unique.

Two tokens may stand side by side if merging their joined bytes leaves them as they are. Where every token's rank is above those of its two
halves, that is told from the halves alone: the border of the two tokens is followed from single bytes on, rank by rank, until a merge would cross
it. Other files of ranks are merged plainly. Answers are memoised, as are the ids of short pieces.

A sequence whose neighbours all may stand side by side is what merging gives, so the ids are exactly those of merging, however long a piece is.
A piece that is itself a token stays whole, even if merging could not reach it, as in the tiktoken library. Letters and numbers are those of that
library's Unicode version, which the driver asks for.

Defined cases: a null or empty text has no ids; repeated texts are treated alike; columns named like an output column are replaced (or, with
`key`, left out); ids that no token has can't be decoded and raise an error; a null list of ids decodes to null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import scratch, tokens

#: Bytes of text that are encoded at a time.
_SLICE_BYTES = 4 << 20
#: Characters of the segments that long texts are encoded in, and where they may be cut: before a single space between two plain words.
_SEGMENT, _CUT = 1 << 18, re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
#: Pieces of so many characters at most are memoised; so many new pieces, and as many older ones, and so many pairs of tokens at a time.
_SHORT, _MOST_PIECES, _MOST_PAIRS = 64, 1 << 18, 1 << 20
#: What stands in, while a text is cut, for a character that two Unicode versions class differently: no part of a contraction.
_STAND_IN = {"letter": "a", "number": "1", "other": "!"}


def merge(raw: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Parts left when the neighbours of least rank are merged again and again, leftmost first, and the pair that was merged last."""
    parts, last = [raw[i : i + 1] for i in range(len(raw))], None
    while len(parts) > 1:
        best, at = min(((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best == 1 << 62:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


@dataclass
class Vocabulary:
    """Tokens by id, the halves that merging joins last (-1: a single byte, -2: merging never gives this token), and character classes."""

    pieces: list[bytes]
    ids: list[int]
    left: list[int]
    right: list[int]
    pattern: str
    odd: dict[int, str]

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines `base64 rank`; it must have all single bytes."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls.of(ranks, pattern)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        order = sorted(ranks, key=ranks.__getitem__)
        left, right = [], []
        for raw in order:
            parts, last = merge(raw, ranks) if len(raw) > 1 else ([raw], None)
            none = -2 if len(parts) > 1 else -1
            left.append(none if last is None or none == -2 else ranks[last[0]])
            right.append(none if last is None or none == -2 else ranks[last[1]])
        return cls(order, [ranks[raw] for raw in order], left, right, pattern, _odd_characters())

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.ids, self.pieces)).encode()).hexdigest()

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return dict(zip(self.pieces, self.ids, strict=True))


def _odd_characters() -> dict[int, str]:
    """Stand-ins of the characters that the pattern library here and tiktoken class differently as letter, number or neither."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    theirs: dict[str, str] = {}
    ours: dict[str, str] = {}
    for kind, name in ((r"\p{L}", "letter"), (r"\p{N}", "number")):
        of_class = tiktoken.Encoding(f"class-{name}", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(of_class.decode(of_class.encode_ordinary(every)), name)
        ours |= dict.fromkeys(regex.findall(kind, every), name)
    return {ord(c): _STAND_IN[theirs.get(c, "other")] for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


class Encoder:
    """Ids of texts and bytes of ids, for one task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick
        import regex

        self.ranks = vocabulary.ranks
        most = max(vocabulary.ids) + 1
        self.raw: list[bytes | None] = [None] * most
        self.halves = [(-2, -2)] * most
        for raw, i, a, b in zip(vocabulary.pieces, vocabulary.ids, vocabulary.left, vocabulary.right, strict=True):
            self.raw[i], self.halves[i] = raw, (a, b)
        self.size = [len(raw or b"") for raw in self.raw]
        self.ordered = all(i > max(h) for i, h in enumerate(self.halves) if h[0] >= 0)
        self.reached = {raw.decode("latin-1"): i for raw, i in self.ranks.items() if self.halves[i][0] != -2}
        self.most = max(map(len, self.reached))
        self.trie = ahocorasick.Automaton()
        for text, i in self.reached.items():
            self.trie.add_word(text, i)
        self.paths: dict[str, int] = {}
        self.fits: list[dict[int, int]] = [{} for _ in range(most)]
        self.pairs = 0
        self.findall, self.odd = regex.compile(vocabulary.pattern).findall, vocabulary.odd
        self.odd_set = frozenset(map(chr, self.odd))
        self.known = _Known(self)
        lengths = np.array(self.size, np.int64)
        self.bytes, self.lengths, self.starts = np.frombuffer(b"".join(r or b"" for r in self.raw), np.uint8), lengths, np.cumsum(lengths) - lengths

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.odd_set.isdisjoint(set(text)):
            return self.findall(text)
        out, at = [], 0
        for piece in self.findall(text.translate(self.odd)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def may_stand(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both leaves the two as they are."""
        if self.ordered:
            return self._border(a, b)
        return merge(self.raw[a] + self.raw[b], self.ranks)[0] == [self.raw[a], self.raw[b]]

    def fitting(self, before: int, token: int) -> int:
        """The longest of a token and those it begins with that may stand after `before`, -1 if none may."""
        if self.pairs >= _MOST_PAIRS:
            self.pairs = 0
            for held in self.fits:
                held.clear()
        found = token
        while found >= 0 and not self.may_stand(before, found):
            found = self.shorter(found)
        self.fits[before][token] = found
        self.pairs += 1
        return found

    def _border(self, a: int, b: int) -> bool:
        """Follow what stands left and right of the border, from single bytes on; the next of lower rank comes first, the leftmost of equals."""
        lefts, rights = [a], [b]
        while (h := self.halves[lefts[-1]])[1] >= 0:
            lefts.append(h[1])
        while (h := self.halves[rights[-1]])[0] >= 0:
            rights.append(h[0])
        x, y, never = lefts.pop(), rights.pop(), 1 << 62
        while True:
            grow_left, grow_right = lefts[-1] if lefts else never, rights[-1] if rights else never
            across = self.ranks.get(self.raw[x] + self.raw[y], never)
            if across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                x = lefts.pop()
            else:
                y = rights.pop()

    def shorter(self, token: int) -> int:
        """The longest token that this one begins with, -1 if there is none."""
        return self.longest(self.raw[token][:-1].decode("latin-1"))

    def longest(self, path: str) -> int:
        """The longest token that a string begins with; memoised, since all strings asked about are ways into the trie."""
        found = self.paths.get(path)
        if found is None:
            found = self.paths[path] = next((i for n in range(len(path), 0, -1) if (i := self.reached.get(path[:n])) is not None), -1)
        return found

    def piece(self, raw: bytes) -> array:
        """Ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None or not raw:
            return array("i", [] if whole is None else [whole])
        text, n, size, fits, most = raw.decode("latin-1"), len(raw), self.size, self.fits, self.most
        path, paths = self.trie.longest_prefix, self.paths.get
        out, dead, at, before, token = array("i"), bytearray(n + 1), 0, -1, self.longest(text[: path(text[:most])])
        while True:
            while token >= 0:
                if before >= 0:
                    fit = fits[before].get(token)
                    token = self.fitting(before, token) if fit is None else fit
                    if token < 0:
                        break
                end = at + size[token]
                if dead[end]:
                    token = self.shorter(token)
                    continue
                out.append(token)
                if end == n:
                    return out
                at, before = end, token
                ahead = text[end : end + most]
                way = ahead[: path(ahead)]
                token = paths(way)
                if token is None:
                    token = self.longest(way)
            dead[at] = 1
            back = out.pop()
            at -= size[back]
            before = out[-1] if out else -1
            token = self.shorter(back)

    def segments(self, text: str) -> Iterator[str]:
        """Parts of a text; none of the pattern's matches spans two of them."""
        at = 0
        while len(text) - at > 2 * _SEGMENT and (cut := _CUT.search(text, at + _SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each segment, and the same in decimal, comma-joined."""
        known = self.known.__getitem__
        for part in self.segments(text):
            if part:
                found = list(map(known, self.split(part)))
                yield np.frombuffer(b"".join([x[0] for x in found]), np.int32), ",".join([x[1] for x in found])
                self.known.bound()

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("there are ids that no token has")
        size = self.lengths[ids]
        return self.bytes[np.repeat(self.starts[ids], size) + tokens.within(size)].tobytes()


class _Known(dict):
    """Ids of short pieces, as bytes of 32-bit integers and in decimal; those of the last generation are kept apart until the next."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> tuple[bytes, str]:
        found = self.older.get(piece)
        if found is None:
            ids = self.encoder.piece(piece.encode())
            found = ids.tobytes(), ",".join(map(str, ids))
        if len(piece) <= _SHORT:
            self[piece] = found
        return found

    def bound(self) -> None:
        if len(self) > _MOST_PIECES:
            self.older = dict(self)
            self.clear()


#: The encoder of this Python worker and the vocabulary it was made for: the next task of the same job finds its pieces known.
_OWN: list[tuple[str, Encoder]] = []


def _encoder(vocabulary: Vocabulary, name: str) -> Encoder:
    if not _OWN or _OWN[0][0] != name:
        _OWN[:] = [(name, Encoder(vocabulary))]
    return _OWN[0][1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """``docs`` (or only its `key`) with the ids of `text`.

    token_ids (if asked for), n_tokens, ids_sha256 (of the decimal ids, comma-joined), and, if asked for, decoded_sha256 (of the bytes that the ids
    stand for) and round_trip (they are the text's). The driver reads the file of ranks; what is broadcast grows with that vocabulary alone.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    loaded = Vocabulary.load(ranks_path, pattern)
    vocabulary, name = spark.sparkContext.broadcast(loaded), loaded.digest
    fields = [
        ("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), ids),
        ("n_tokens", T.LongType(), pa.int64(), True),
        ("ids_sha256", T.StringType(), pa.string(), True),
        ("decoded_sha256", T.StringType(), pa.string(), decoded),
        ("round_trip", T.BooleanType(), pa.bool_(), decoded),
    ]
    source = docs.select(key, text) if key else docs.drop(*(n for n, *_ in fields))
    passed = [f for f in source.schema.fields if not key or f.name == key]
    schema = T.StructType([*passed, *(T.StructField(n, t) for n, t, _, use in fields if use)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, name)
        for batch, _, _ in tokens.slices(batches, text, _SLICE_BYTES):
            rows: list[list] = [[] for _ in fields]
            for value in batch.column(text):
                own, n, digest, back = [], 0, hashlib.sha256(), hashlib.sha256()
                words = value.as_py() or ""
                for found, decimal in encoder.encode(words):
                    digest.update(f",{decimal}".encode() if n else decimal.encode())
                    n += len(found)
                    if ids:
                        own.append(found)
                    if decoded:
                        back.update(encoder.decode(found))
                rows[0].append(np.concatenate(own) if own else np.zeros(0, np.int32))
                rows[1].append(n)
                rows[2].append(digest.hexdigest())
                rows[3].append(back.hexdigest())
                rows[4].append(back.digest() == hashlib.sha256(words.encode()).digest())
            made = [pa.array(r, kind) for r, (_, _, kind, use) in zip(rows, fields, strict=True) if use]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(frame: DataFrame, ranks_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that each row's ids stand for, as the binary column `to`."""
    spark = frame.sparkSession
    scratch.bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(ranks_path, ""))
    source = frame.drop(to)
    schema = T.StructType([*source.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            back = [None if x is None else encoder.decode(np.array(x, np.int32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)
