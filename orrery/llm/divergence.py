"""Which sources of a language use its words differently, and which words: an index of terms with corrections to a baseline.

Terms are runs of ASCII letters, lower-cased, and of all characters beyond ASCII. A language keeps the V terms that enough of its documents have.
A group (language, source) gives a term of count c the share p = 1 + floor(unit * (c + add) / (N + add * V)), N being its count of kept terms.

The distance of two sources is the sum of |p - q| over all kept terms. Each pair starts at V times the difference for a count of zero. A term
that only one source has corrects that start by what follows from its p and the other's zero share; such terms are put together by p, as many
of a source's terms have the same count. A term's postings correct it for the pairs of sources that share the term: tasks add these corrections
up by pair before anything is shuffled, and corrections of nothing are not sent. So the work grows with the postings, not with pairs times terms.

Hot keys: words are counted in each slice of texts before they are shuffled, by (language, source, term); a term has a posting for each source at
most. What meets by language is dealt by a salt too. A ranking of terms keeps only its first ranks before it is shuffled.

Defined cases: null texts, languages and sources are empty strings; a group without any kept term counts, with N = 0; a language that keeps no
term has pairs of value 0; a language of one source has no pairs; repeated documents each count; an empty table gives an empty result; other
columns are ignored. Shares are exact integers of 64 bits, their products decimals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_SLICE_BYTES = 8 << 20
#: Sources in one block of zero shares; parts that a language's sources are dealt to; corrections worked out at a time; pairs counted in place.
_BLOCK, _SALT, _STEP, _DENSE = 4096, 32, 1 << 21, 1 << 22


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that have it)."""
    scratch.bound_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(text).alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tokens.slices(batches, "text", _SLICE_BYTES):
            pairs: dict[tuple[str, str], int] = {}
            group = np.array([pairs.setdefault(k, len(pairs)) for k in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)])
            words = tokens.split(data, offsets, _LETTERS, lower=True)
            if not len(words.start):
                continue
            _, place, term = np.unique(words.hashes(), return_index=True, return_inverse=True)
            in_document, n = np.unique(term * len(group) + words.text_of_word(), return_counts=True)
            term, document = np.divmod(in_document, len(group))
            order = np.argsort(both := term * len(pairs) + group[document], kind="stable")
            begin = np.flatnonzero(np.diff(both[order], prepend=-1))
            term, own = np.divmod(both[order][begin], len(pairs))
            names = list(pairs)
            start, size = words.start[place[term]], (words.end - words.start)[place[term]]
            raw = words.data[np.repeat(start, size) + tokens.within(size)]
            ends = np.concatenate([[0], np.cumsum(size)])
            spelled = pa.LargeStringArray.from_buffers(len(term), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())
            name = lambda i: pa.array([k[i] for k in names]).take(pa.array(own))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([name(0), name(1), spelled, pa.array(np.add.reduceat(n[order], begin)), pa.array(np.diff(np.append(begin, len(both))))], names=["lang", "source", "term", "n", "d"])

    found = rows.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column, unit: int, add: int) -> Column:
    """1 + floor(unit * (count + add) / (total + add * terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = F.lit(unit).cast("decimal(10,0)") * wide(count + add)
    return F.when(terms > 0, F.call_function("div", product, wide(total + add * terms)) + 1)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms' postings correct for the pairs of sources that share a term: |p - q| + |z - y| - |p - y| - |z - q|, summed by pair."""
    for batch in batches:
        postings = batch.column("postings")
        counts = np.diff(postings.offsets.to_numpy())
        flat = postings.flatten()
        sources = flat.field("source").dictionary_encode()
        names = sources.dictionary
        order = np.argsort(np.array(names.to_pylist(), object)) if len(names) else np.zeros(0, np.int64)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))  # sources by name, so that each pair is told once
        languages = batch.column("lang").dictionary_encode()
        lang = languages.indices.to_numpy(zero_copy_only=False)
        own, p, z = place[sources.indices.to_numpy(zero_copy_only=False)], flat.field("p").to_numpy(zero_copy_only=False), flat.field("z").to_numpy(zero_copy_only=False)
        first, many = np.cumsum(counts) - counts, len(names)
        dense = len(languages.dictionary) * many * many <= _DENSE
        total = np.zeros(len(languages.dictionary) * many * many if dense else 0, np.int64)
        sparse: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(counts[counts > 1]):
            terms = np.flatnonzero(counts == width)
            left = max(1, min(width, _STEP // width))
            each = max(1, _STEP // (left * width))
            for at in range(0, len(terms), each):
                some = terms[at : at + each]
                right = first[some][:, None] + np.arange(width)
                for a in range(0, width, left):
                    mine, theirs = right[:, a : a + left, None], right[:, None, :]
                    value = np.abs(p[mine] - p[theirs]) + np.abs(z[mine] - z[theirs]) - np.abs(p[mine] - z[theirs]) - np.abs(z[mine] - p[theirs])
                    pair = (lang[some][:, None, None] * many + own[mine]) * many + own[theirs]
                    use = (own[mine] < own[theirs]) & (value != 0)
                    pair, value = pair[use], value[use]
                    # each sum has fewer than 2^22 values of less than 2^31, so that doubles hold it exactly
                    if dense:
                        total += np.bincount(pair, value, len(total)).astype(np.int64)
                    else:
                        code, inverse = np.unique(pair, return_inverse=True)
                        sparse.append((code, np.bincount(inverse, value, len(code)).astype(np.int64)))
        code = np.flatnonzero(total) if dense else np.concatenate([c for c, _ in sparse] or [np.zeros(0, np.int64)])
        value = total[code] if dense else np.concatenate([v for _, v in sparse] or [np.zeros(0, np.int64)])
        rest, b = np.divmod(code, max(1, many))
        of_lang, a = np.divmod(rest, max(1, many))
        named = names.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([languages.dictionary.take(pa.array(of_lang)), named.take(pa.array(a)), named.take(pa.array(b)), pa.array(value)], names=["lang", "a", "b", "value"])


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a source and a block of others: the start of each pair (told by the lesser name), and the corrections as if no other had its terms."""
    for batch in batches:
        for row in batch.to_pylist():
            p, m = np.array([x["p"] for x in row["levels"]], np.int64), np.array([x["m"] for x in row["levels"]], np.int64)
            order = np.argsort(p)
            p, m = p[order], m[order]
            terms, mass = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m * p)])
            others = [x for x in row["others"] if x["source"] != row["source"]]
            z, mine = np.array([x["z"] for x in others], np.int64), row["z"]
            below = np.searchsorted(p, z, "right")
            apart = z * terms[below] - mass[below] + (mass[-1] - mass[below]) - z * (terms[-1] - terms[below])
            value = apart - terms[-1] * np.abs(z - mine)
            lesser = np.array([row["source"] < x["source"] for x in others], bool)
            value += np.where(lesser, row["terms"] * np.abs(z - mine), 0)
            names = [x["source"] for x in others]
            pairs = [(row["source"], n) if less else (n, row["source"]) for n, less in zip(names, lesser, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(value)], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_documents: int = 30, ranks: int = 50, unit: int = 1_000_000_000, add: int = 5, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank.

    `pair`: each other source of the language with its distance, all of them; `term`: the terms that the group has more of than its language, by how
    much more their share is, the first `ranks`.
    """
    if unit + 1 >= 1 << 31:
        raise ValueError("shares must be below 2^31")
    of_term = Window.partitionBy("lang", "term")
    kept = counted(docs, text, lang, source).withColumns({"documents": F.sum("d").over(of_term), "lang_n": F.sum("n").over(of_term), "told": (F.col("source") == F.min("source").over(of_term)).cast("long")})
    kept = scratch.stored(kept.where(F.col("documents") >= least_documents).drop("documents", "d"), "kept-terms")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")).drop("documents")
    of_group, of_lang = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("told").alias("terms"))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "terms")}
    groups = seen.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumns(none)
    groups = scratch.stored(groups.withColumn("z", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), unit, add), F.lit(0))), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), unit, add))
    more = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), unit, add)).where("p > q")
    ranked = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", ranked()).where(F.col("rank") <= ranks)

    postings = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("postings")).select("lang", "postings")
    pair = "lang string, a string, b string, value long"
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("levels"))
    salt = F.pmod(F.xxhash64("source"), F.lit(_SALT)).cast("int")
    mine = groups.join(levels, ["lang", "source"], "left").select("lang", "source", "z", "terms", F.coalesce("levels", F.array().cast("array<struct<p:bigint,m:bigint>>")).alias("levels"), salt.alias("salt"))
    blocks = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / _BLOCK)).groupBy("lang", "block").agg(F.collect_list(F.struct("source", "z")).alias("others"))
    blocks = blocks.select("lang", "others", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
    found = mine.join(blocks, ["lang", "salt"]).drop("salt").mapInArrow(_alone, pair).unionByName(postings.mapInArrow(_shared, pair))
    found = scratch.stored(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    way = lambda a, b: found.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value")
    pairs = way("a", "b").unionByName(way("b", "a")).withColumn("rank", ranked())
    return pairs.unionByName(terms)
