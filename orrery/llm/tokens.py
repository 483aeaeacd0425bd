"""Words of UTF-8 texts as numpy arrays: whole Arrow batches at a time, without a Python object for each word.

Both word classes used here are defined on bytes below 0x80, so that bytes of longer UTF-8 sequences always belong
to words and the work can be done on bytes. Word hashes have 64 bits; sequences of words can be given 128.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that one slice has at most, unless a single text is longer.
SLICE_BYTES = 2 << 20
#: Bytes that are hashed at a time, so that the tables of powers stay small.
_HASH_BLOCK = 1 << 18

def release() -> None:
    """Give memory that is free but held back to the system: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(task: Callable) -> Callable:
    """The same task on a group of rows, with its memory given back when it is done."""

    def done(*tables: pa.Table) -> pa.Table:
        try:
            return task(*tables)
        finally:
            release()

    # Spark tells from the number of arguments whether a task wants the group's key too
    if len(inspect.signature(task).parameters) == 1:
        return lambda table: done(table)
    return lambda left, right: done(left, right)


_ALL = np.arange(256)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
#: Words are runs of anything but white space.
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Words are runs of digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = ~((_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x60)) | ((_ALL >= 0x7B) & (_ALL <= 0x7F)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, kept as long as they were needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = tuple(map(_Powers, _WORD_BASES))


@dataclass
class Words:
    """Words of some texts. ``first[k]:first[k + 1]`` are those of text k; start and end are places in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self.start), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.data), _HASH_BLOCK)), len(self.start)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = self.start[i], self.end[j - 1]
            up, down = _BYTE_POWERS.get(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            start, end = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
        return mix(out)


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Words of the texts ``data[offsets[k]:offsets[k + 1]]``: longest runs of bytes of ``kind``, A-Z lower-cased first if asked."""
    if lower:
        data = LOWER[data]
    offsets = offsets.astype(np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here, before, after = inside[1:-1], inside[:-2], inside[2:]
    start = np.flatnonzero(here & (~before | edge[:-1]))
    end = np.flatnonzero(here & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def sequences(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each ``length`` words in a row, by the place of the first; rows that run over a text's end are the caller's to drop."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS[which].get(len(hashes) + 1)
    values = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if which else hashes
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n] + np.uint64(length))


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run of words ``start[k]:end[k]``; equal runs of any place get equal hashes, those of `sequences`."""
    up, down = _WORD_POWERS[which].get(len(hashes) + 1)
    values = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if which else hashes
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def inside_text(words: Words, length: int) -> np.ndarray:
    """Places of words at which ``length`` words in a row stay in one text."""
    counts = np.maximum(words.counts - length + 1, 0)
    return np.repeat(words.first[:-1], counts) + within(counts)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n of ``counts``, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most so many bytes of text (one text at least), and the texts' bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and offsets."""
    length = (words.end - words.start)[keep]
    text = words.text_of_word()[keep]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    sized = length + ~last
    total = int(sized.sum())
    out = np.full(total, 0x20, np.uint8)
    to = np.cumsum(sized) - sized
    step = within(length)
    out[np.repeat(to, length) + step] = words.data[np.repeat(words.start[keep], length) + step]
    offsets = np.zeros(len(words.counts) + 1, np.int64)
    np.cumsum(np.bincount(text, sized, len(words.counts)).astype(np.int64), out=offsets[1:])
    return out, offsets
