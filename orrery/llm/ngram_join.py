"""Exact Jaccard self-join of word n-gram sets by signature trees.

A leaf of a signature tree is a document's set as a bitmap; a node holds the OR of its children's bitmaps and the range of
their sizes. Two sets share at most as many n-grams as their bitmaps share bits, plus the n-grams that fell on a bit already
taken; so the shared bits of two nodes, with the greatest such surplus below them, bound every overlap below them. A dual
traversal from the roots drops pairs of nodes that cannot hold a link, and what is left at the leaves is counted exactly.

To deal the work out, each set asks how many sets hold each of its n-grams (see `lookup`) and puts them in order of rarity.
Two sets that link share one of their first `n - ceil(t * n) + 1` n-grams in that order, and an n-gram that one set alone holds
links nothing. Sets that share one are candidates; a component of candidates gets one tree. A large component's upper nodes are dealt
over tasks: its sets are parted by size, into bands of which only neighbours can hold a link, and bands into parts of a tree's
size. Nodes whose size ranges are too far apart are never brought together; each two of the others get a tree. Every pair of sets that a tree leaves is verified, so each document's number of links is
exact, and the components follow from the links. A tile tells each of its sets' links and least companion, not the pairs, so
that its rows grow with the sets.

Equal sets are one class and are compared once; their documents link with each other and share the class's links. n-grams are told by 64 bits of hash, classes by 128.

Defined cases: null and empty texts have an empty set, which links with nothing, not even its like; a text of fewer words
than n is one n-gram; rows with a null id belong to components but don't name them; repeated rows link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, lookup, scratch, substring, tokens

FAN_OUT = 8
#: n-grams that one tree's sets hold together at most, unless two sets alone have more.
TREE_NGRAMS = 2_000_000
_PAIRS = 1 << 11
#: n-grams that are looked up at a time when pairs are verified.
_VERIFIED = 1 << 20


class Sets:
    """Sorted distinct n-grams of some texts: ``values[first[k]:first[k + 1]]``; equal sets have equal keys."""

    def __init__(self, words: tokens.Words, size: int) -> None:
        hashes = words.hashes()
        place = tokens.inside_text(words, size)
        grams = tokens.sequences(hashes, size)[place] if len(place) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(words.counts)), np.maximum(words.counts - size + 1, 0))
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        grams = np.concatenate([grams, tokens.spans(hashes, words.first[short], words.first[short + 1])])
        owner = np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = grams[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(words.counts) + 1))
        self.sizes = np.diff(self.first)
        sums = []
        for salt in (0x1234567, 0xFEDCBA9876543):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(self.values ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append(tokens.mix(run[self.first[1:]] - run[self.first[:-1]] + self.sizes.astype(np.uint64)))
        self.keys = np.stack(sums, axis=1)

    def key_bytes(self) -> list[bytes]:
        raw = np.ascontiguousarray(self.keys.astype(">u8")).tobytes()
        return [raw[16 * k : 16 * k + 16] for k in range(len(self.keys))]

    def classes(self) -> np.ndarray:
        """One text of each class that is not empty."""
        _, first = np.unique(self.keys, axis=0, return_index=True)
        return np.sort(first[self.sizes[first] > 0])


def _counts(table: pa.Table) -> pa.Table:
    """For every chunk's question about this bucket: how many sets hold each n-gram."""
    rows = table.to_pylist()
    hashes = [lookup.unpack_sorted(r["hashes"], np.uint64) for r in rows]
    counts = np.concatenate([lookup.unpack_counts(r["counts"]) for r in rows])
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, counts).astype(np.int64)[back]
    parts = np.split(total, np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table({"__chunk": [r["__chunk"] for r in rows], "bucket": pa.array([r["__bucket"] for r in rows], pa.int32()), "counts": [lookup.pack_counts(p) for p in parts]})


class Tree:
    """A signature tree over some sets: levels from the leaves up."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets])
        width = 256
        while width < 2 * np.median(sizes) and width < 1 << 14:
            width *= 2
        self.order = np.lexsort((sizes, [int(s[0]) for s in sets]))
        sizes = sizes[self.order]
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, k in enumerate(self.order):
            at = (sets[k] % np.uint64(width)).astype(np.int64)
            np.bitwise_or.at(bits[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        surplus = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, surplus)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, s = self.levels[-1]
            cut = np.arange(0, len(low), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(s, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
        """Which pairs of nodes may hold a link of Jaccard similarity p / q or more."""
        bits, low, high, surplus = self.levels[level]
        keep = (q * high[j] >= p * low[i]) & (q * high[i] >= p * low[j])
        at = np.flatnonzero(keep)
        shared = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(axis=1).astype(np.int64) + np.minimum(surplus[i[at]], surplus[j[at]])
        most = np.minimum(shared, np.minimum(high[i[at]], high[j[at]]))
        keep[at] = (p + q) * most >= p * (low[i[at]] + low[j[at]])
        return keep


class Union:
    """Disjoint sets."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[back]

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def _similar(values: np.ndarray, first: np.ndarray, mark: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which pairs of sets values[first[k]:first[k + 1]] have a similarity of p / q or more; mark: a false for each value, left so."""
    out = np.zeros(len(i), bool)
    sizes = np.diff(first)
    order = np.argsort(i, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(i[order], prepend=-1)), len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        one = i[order[a]]
        own = values[first[one] : first[one + 1]]
        mark[own] = True
        held = np.cumsum(sizes[j[order[a:b]]])
        steps = np.append(np.unique(np.searchsorted(held, np.arange(0, held[-1], _VERIFIED))), b - a) + a
        for x, y in zip(steps[:-1], steps[1:], strict=True):
            others = j[order[x:y]]
            counts = sizes[others]
            hit = mark[values[np.repeat(first[others], counts) + tokens.within(counts)]]
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(counts) - counts)
            out[order[x:y]] = q * both >= p * (sizes[one] + counts - both)
        mark[own] = False
    return out


def links(sets: list[np.ndarray], p: int, q: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """All pairs of sets of similarity p / q or more; with parts, those of two parts."""
    return [(int(a), int(b)) for i, j in _linked(sets, p, q, parts) for a, b in zip(i, j, strict=True)]


def _linked(sets: list[np.ndarray], p: int, q: int, parts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, as arrays of both sides."""
    if len(sets) < 2:
        return
    tree = Tree(sets)
    distinct, values = np.unique(np.concatenate([sets[k] for k in tree.order]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(tree.levels[0][1])])
    mark = np.zeros(len(distinct), bool)
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > _PAIRS:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        keep = tree.possible(level, i, j, p, q)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level:
            size = len(tree.levels[level - 1][1])
            a, b = (np.repeat(np.arange(FAN_OUT), FAN_OUT), np.tile(np.arange(FAN_OUT), FAN_OUT))
            x, y = (i[:, None] * FAN_OUT + a).ravel(), (j[:, None] * FAN_OUT + b).ravel()
            ok = (x < size) & (y < size) & (x <= y if level > 1 else x < y)
            if level == 1 and parts is not None:
                ok[ok] = parts[tree.order[x[ok]]] != parts[tree.order[y[ok]]]
            stack.append((level - 1, x[ok], y[ok]))
            continue
        good = _similar(values, first, mark, i, j, p, q)
        if good.any():
            yield tree.order[i[good]], tree.order[j[good]]


def _candidates(docs: DataFrame, key: str, text: str, size: int, p: int, q: int, chunk_bytes: int) -> DataFrame:
    """A stored table of rows of three kinds. 0: a document's id, size and class, and as `gram` the hash of its text; 1: an n-gram of a class's prefix that more
    than one set holds; 2: the n-grams of a class that has any such."""
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    parts, total = lookup.dealt(docs.select(key, text), key, text, chunk_bytes)
    parts = parts.select("__chunk", F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), F.coalesce(text, F.lit("")).alias("__text"))
    n = lookup.buckets(total)
    id_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", id_type), *T._parse_datatype_string("n long, class binary, gram long, grams binary").fields])

    def sets_of(table: pa.Table) -> tuple[pa.Table, Sets]:
        table = substring._sorted_texts(table)
        return table, Sets(tokens.split(*tokens.buffers(table.column("__text")), tokens.NON_SPACE, True), size)

    def chosen(sets: Sets, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the classes' n-grams, class after class, and each class's first."""
        counts = sets.sizes[classes]
        return np.repeat(sets.first[classes], counts) + tokens.within(counts), np.concatenate([[0], np.cumsum(counts)])

    def first(table: pa.Table) -> pa.Table:
        chunk = table.column("__chunk")[0].as_py()
        _, sets = sets_of(table)
        hashes, counts = np.unique(sets.values[chosen(sets, sets.classes())[0]], return_counts=True)
        rows = [(b, lookup.pack_sorted(hashes[i:j]), lookup.pack_counts(counts[i:j])) for b, i, j in lookup.ranges(hashes, n)]
        return pa.table({"__bucket": pa.array([r[0] for r in rows], pa.int32()), "__chunk": pa.array([chunk] * len(rows), pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, sets = sets_of(table)
        classes = sets.classes()
        place, begin = chosen(sets, classes)
        values = sets.values[place]
        told = np.concatenate([lookup.unpack_counts(r["counts"]) for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"])] or [np.zeros(0, np.int64)])
        held = told[np.unique(values, return_inverse=True)[1]] if len(values) else told
        sizes = sets.sizes[classes]
        owner = np.repeat(np.arange(len(classes)), sizes)
        order = np.lexsort((values, held, owner))
        prefix = sizes - -(-p * sizes // q) + 1
        early = tokens.within(sizes) < prefix[owner]
        picked = order[early & (held[order] > 1)]
        asks = np.unique(owner[picked])
        keys = sets.key_bytes()
        ids = table.column("__key").combine_chunks()
        empty, none = table.num_rows, len(picked) + len(asks)
        columns = {
            "kind": pa.array(np.repeat([0, 1, 2], [empty, len(picked), len(asks)]), pa.int32()),
            "id": pa.concat_arrays([ids, pa.nulls(none, ids.type)]),
            "n": pa.array(np.concatenate([sets.sizes, sizes[owner[picked]], sizes[asks]]), pa.int64()),
            "class": pa.array([*keys, *(keys[k] for k in classes[owner[picked]]), *(keys[k] for k in classes[asks])], pa.binary()),
            "gram": pa.concat_arrays([table.column("__hash").combine_chunks(), pa.array(values[picked].view(np.int64)), pa.nulls(len(asks), pa.int64())]),
            "grams": pa.array([None] * (empty + len(picked)) + [lookup.pack_sorted(values[begin[k] : begin[k + 1]]) for k in asks], pa.binary()),
        }
        return pa.table(columns)

    asked = parts.groupBy("__chunk").applyInArrow(tokens.released(first), "__bucket int, __chunk long, hashes binary, counts binary")
    answers = asked.groupBy("__bucket").applyInArrow(tokens.released(_counts), "__chunk long, bucket int, counts binary")
    return scratch.stored(parts.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(tokens.released(second), schema), "ngrams")


def _joined(tiles: DataFrame, p: int, q: int) -> DataFrame:
    """Of each class with a link in a tile: the least class that its links there lead to, and how many documents they lead to directly."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes, int]] = []
        component, classes, grams, parts, copies = (table.column(c).to_pylist() for c in ("component", "class", "grams", "part", "copies"))
        cross = table.column("cross")[0].as_py()
        order = sorted(range(len(classes)), key=lambda k: (component[k], classes[k]))
        at = 0
        while at < len(order):
            to = at
            while to < len(order) and component[order[to]] == component[order[at]]:
                to += 1
            own = order[at:to]
            at = to
            weight, linked = np.array([copies[k] for k in own]), np.zeros(len(own), np.int64)
            union = Union(np.arange(len(own)))
            for a, b in _linked([lookup.unpack_sorted(grams[k], np.uint64) for k in own], p, q, np.array([parts[k] for k in own]) if cross else None):
                np.add.at(linked, a, weight[b])
                np.add.at(linked, b, weight[a])
                root = union.roots()
                new = root[a] != root[b]
                for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                    union.join(x, y)
            root = union.roots()
            out += [(classes[own[k]], classes[own[root[k]]], int(linked[k])) for k in np.flatnonzero(linked)]
        return pa.table({"a": pa.array([x for x, _, _ in out], pa.binary()), "b": pa.array([y for _, y, _ in out], pa.binary()), "links": pa.array([n for *_, n in out], pa.int64())})

    return tiles.groupBy("tile", "other").applyInArrow(tokens.released(run), "a binary, b binary, links long")


def _tiles(members: DataFrame, p: int, q: int, tree_ngrams: int) -> DataFrame:
    """The sets of large components, each in every tile that could hold a link of it: with the other parts of its band of sizes, and
    with the parts of the bands beside it."""
    # a link's sizes differ by a factor of q / p at most; the bands are wider by what floating point may be off
    band = F.col("n") if p == q else F.floor(F.log(F.col("n").cast("double")) / (math.log(q / p) * (1 + 1e-9))).cast("long")
    banded = members.withColumn("band", band)
    sizes = banded.groupBy("component", "band").agg(F.ceil(F.sum("n") / (tree_ngrams / 2)).cast("long").alias("parts"))
    sizes = scratch.stored(sizes, "bands")
    beside = lambda step, name: sizes.select("component", (F.col("band") - step).alias("band"), F.col("parts").alias(name))
    dealt = banded.join(sizes, ["component", "band"]).join(beside(1, "above"), ["component", "band"], "left").join(beside(-1, "below"), ["component", "band"], "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("parts")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    each = lambda n, tile: F.transform(F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<bigint>")), tile)
    node = lambda low, high, i, j: F.concat_ws(":", low.cast("string"), high.cast("string"), i.cast("string"), j.cast("string"))
    tile = lambda other, part, cross: F.struct(other.alias("other"), part.alias("part"), cross.alias("cross"))
    band, salt = F.col("band"), F.col("salt")
    own = each(F.col("parts"), lambda j: tile(node(band, band, F.least(salt, j), F.greatest(salt, j)), salt, salt != j))
    none = F.lit(0).cast("long")
    over = each(F.coalesce("above", none), lambda j: tile(node(band, band + 1, salt, j), zero, F.lit(True)))
    under = each(F.coalesce("below", none), lambda j: tile(node(band - 1, band, j, salt), one, F.lit(True)))
    beside_too = F.array().cast("array<struct<other:string,part:bigint,cross:boolean>>") if p == q else F.concat(over, under)
    return dealt.withColumn("t", F.explode(F.concat(own, beside_too))).select("component", "class", "grams", "copies", "t.*", F.hex("component").alias("tile"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, similarity: tuple[int, int] = (90, 100), tree_ngrams: int = TREE_NGRAMS, chunk_bytes: int = lookup.CHUNK_BYTES) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest id that links lead to."""
    return joined(docs, key, text, size, similarity, tree_ngrams, chunk_bytes).drop("n_links", "text_hash", "root")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, similarity: tuple[int, int] = (90, 100), tree_ngrams: int = TREE_NGRAMS, chunk_bytes: int = lookup.CHUNK_BYTES) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest id that links lead to), n_links (the number of other rows it links with),
    text_hash (xxhash64 of its text) and root: equal for the rows of a component, null for a row that links with none."""
    p, q = similarity
    spark = docs.sparkSession
    every = _candidates(docs, key, text, size, p, q, chunk_bytes)
    prefixes = every.where("kind = 1").select("gram", "class")
    shared = prefixes.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("gram", "lo")
    near = graph.connected_components(prefixes.join(shared, "gram").select("class", "lo").distinct(), "class", "lo")
    near = near.select(F.col("node").alias("class"), F.col("root").alias("component"))
    sets = every.where("kind = 2").groupBy("class").agg(F.first("grams").alias("grams"), F.first("n").alias("n"))
    rows = every.where("kind = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("gram").alias("text_hash"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    reps = scratch.stored(rows.where("n_shingles > 0").groupBy("class").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    members = scratch.stored(near.join(sets, "class").join(reps.select("class", "copies"), "class"), "members")

    columns = ("component", "class", "grams", "copies", "part", "cross", "tile", "other")
    held = members.groupBy("component").agg(F.sum("n").alias("held"))
    large = scratch.stored(held.where(F.col("held") > tree_ngrams).select("component"), "large")
    groups = max(1, (members.agg(F.sum("n")).first()[0] or 0) // tree_ngrams + 1)
    small = members.join(large, "component", "left_anti").withColumns({"tile": F.pmod(F.xxhash64("component"), F.lit(groups)).cast("string"), "other": F.lit(""), "part": F.lit(0).cast("long"), "cross": F.lit(False)})
    found = _joined(small.select(*columns), p, q)
    if not large.isEmpty():
        found = found.union(_joined(_tiles(members.join(large, "component", "left_semi"), p, q, tree_ngrams).select(*columns), p, q))
    found = scratch.stored(found, "links")
    near_links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = graph.connected_components(found, "a", "b").select(F.col("node").alias("class"), "root")

    named = roots.join(reps, "class").join(near_links, "class")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked = named.join(least, "root").select("class", "root", "least", (F.col("links") + F.col("copies") - 1).alias("links"), "copies")
    copied = reps.where("copies > 1").join(roots, "class", "left_anti").select("class", F.col("class").alias("root"), F.col("rep").alias("least"), (F.col("copies") - 1).alias("links"), "copies")
    special = scratch.stored(linked.union(copied), "components")
    told = scratch.join_hot(rows, special, "class", "copies")
    return told.select(key, "n_shingles", F.coalesce("least", key).alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "text_hash", "root")
