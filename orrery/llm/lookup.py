"""Asking the whole corpus about hashes, a chunk of documents at a time.

Documents are dealt into chunks by a hash of their id, text and place, one exchange for all passes of an operator. A chunk asks
about its distinct hashes in sorted order, cut into ranges of the hash space (buckets); each bucket is answered by one task
that sees every chunk's question about that range, in the order asked, so that an answer needs no keys. A hash that a third
of all documents hold is asked once by each chunk, so no bucket gets more of it than there are chunks.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

CHUNK_BYTES = 4 << 20
BUCKET_HASHES = 1_500_000
#: Bytes of text for each word, at least so many in common prose; only the buckets' sizes depend on it.
_BYTES_PER_WORD = 6


def dealt(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with a `__chunk` of about so many bytes of text, and the bytes of all texts.

    Rows are also told apart by their place in the input, so that rows of one id and text don't all come to one chunk. A task that runs
    again must read its rows in the same order, as tasks over files do; so what is not read from files as it stands is stored first.
    """
    docs = docs if _read_from_files(docs) else scratch.stored(docs, "dealt")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    return docs.withColumn("__chunk", F.pmod(F.xxhash64(key, text, F.monotonically_increasing_id()), F.lit(chunks))), total


def _read_from_files(docs: DataFrame) -> bool:
    """Whether the rows come straight from files: nothing but columns and conditions in between."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation")) and bool(docs.inputFiles())


def buckets(total_bytes: int, hashes_per_word: float = 1.0, most: int = BUCKET_HASHES) -> int:
    return max(1, int(total_bytes / _BYTES_PER_WORD * hashes_per_word / most) + 1)


def bounds(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the hash space begins and ends in the sorted hashes."""
    step = (1 << 64) // n + 1
    return np.searchsorted(hashes, np.array([k * step for k in range(n)] + [(1 << 64) - 1], np.uint64), "left") if n > 1 else np.array([0, len(hashes)])


def ranges(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the ranges that hold any of the sorted hashes."""
    at = bounds(hashes, n)
    at[-1] = len(hashes)
    return [(b, int(at[b]), int(at[b + 1])) for b in range(n) if at[b + 1] > at[b]]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=np.zeros(1, numbers.dtype)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place at which each stands, and each value's place among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def pack_counts(counts: np.ndarray) -> bytes:
    """Non-negative integers, of one column or several, each column in as few bytes as its greatest needs (up to eight), compressed."""
    table = counts if counts.ndim > 1 else counts[:, None]
    sizes = [next(b for b in (1, 2, 4, 8) if b == 8 or int(x) >> 8 * b == 0) for x in (table.max(axis=0) if len(table) else np.zeros(table.shape[1], int))]
    planes = [np.ascontiguousarray(np.ascontiguousarray(table[:, k], f"<u{b}").view(np.uint8).reshape(-1, b).T).tobytes() for k, b in enumerate(sizes)]
    return zstandard.compress(np.array([counts.ndim, *counts.shape, *sizes], "<i8").tobytes() + b"".join(planes), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    number = lambda k: int(np.frombuffer(raw, "<i8", 1, 8 * k)[0])
    shape = [number(1 + k) for k in range(number(0))]
    n, wide = shape[0], shape[1] if len(shape) > 1 else 1
    at = 8 * (1 + len(shape) + wide)
    out = np.empty((n, wide), np.int64)
    for k in range(wide):
        b = number(1 + len(shape) + k)
        out[:, k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * b, at).reshape(b, n).T).reshape(-1).view(f"<u{b}")
        at += n * b
    return out.reshape(shape)
