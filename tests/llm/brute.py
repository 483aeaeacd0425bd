"""Plain restatements of the operators' contracts, for comparison on small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id, divisor, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor == remainder


def _discounts(counts, k, least):
    n = Counter(counts)
    d = {r: (0.0 if r < least else 1.0) for r in range(k + 1)}
    if n[1]:
        a = (k + 1) * n[k + 1] / n[1]
        for r in range(max(1, least), k + 1):
            if n[r] and a < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
                d[r] = x if 0 < x < 1 else 1.0
    return lambda c: d.get(c, 1.0)


class Katz:
    """A bigram model straight from the definition."""

    def __init__(self, texts, k=5, least=2):
        self.words, self.pairs, self.events = Counter(), Counter(), Counter()
        for t in texts:
            before = "<begin>"
            for w in self.tokens(t):
                self.words[w] += 1
                self.pairs[before, w] += 1
                self.events[before] += 1
                before = w
        self.total, self.distinct = sum(self.words.values()), len(self.words)
        dw, self.dp = _discounts(self.words.values(), k, 1), _discounts(self.pairs.values(), k, least)
        self.single = {w: dw(c) * c / self.total for w, c in self.words.items()}
        self.unseen = 1 - math.fsum(self.single.values())
        if self.unseen <= 1e-15:
            self.single = {w: dw(c) * c / (self.total + 1) for w, c in self.words.items()}
            self.unseen = 1 / (self.total + 1)
        self.kept = {p: c for p, c in self.pairs.items() if c >= least}
        follow = defaultdict(list)
        for (u, w), c in self.kept.items():
            follow[u].append((w, c))
        self.base, self.alpha = {}, {}
        for u, n in self.events.items():
            mass = math.fsum(self.dp(c) * c for _, c in follow[u])
            rest = n - mass
            more = rest <= 1e-9 * n
            self.base[u] = n + more
            self.alpha[u] = (1 if more else rest) / self.base[u] / (1 - math.fsum(self.single[w] for w, _ in follow[u]))

    @staticmethod
    def tokens(text):
        return [*SPACED.findall((text or "").translate(LOWER)), ("end",)]

    def probability(self, u, w):
        if (u, w) in self.kept:
            return self.dp(self.kept[u, w]) * self.kept[u, w] / self.base[u]
        return self.alpha.get(u, 1.0) * self.single.get(w, self.unseen)

    def score(self, text):
        tokens = self.tokens(text)
        if not self.total:
            return 0.0
        return sum(math.log10(self.probability(u, w)) for u, w in zip(["<begin>", *tokens], tokens))

    def base_score(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.total + self.distinct + 1)) for w in self.tokens(text))


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """docs: (id, text); items: (id, text). Per document: n_words, n_hit, sorted item ids."""
    wanted = defaultdict(set)
    for i, text in items:
        w = alnum_words(text)
        if w:
            k = min(window, len(w))
            for p in range(len(w) - k + 1):
                wanted[tuple(w[p : p + k])].add(i)
    sizes = {len(k) for k in wanted}
    out = []
    for i, text in docs:
        w, hit, seen = alnum_words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                found = wanted.get(tuple(w[p : p + k]))
                if found:
                    hit.update(range(p, p + k))
                    seen |= found
        out.append((i, len(w), len(hit), sorted(str(x) for x in seen if x is not None)))
    return out


def repeats(docs, window=35):
    """Per document: n_words, kept words."""
    words = [SPACED.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = {q for p in range(len(w) - window + 1) if count[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((i, len(w), [x for q, x in enumerate(w) if q not in gone]))
    return out


def components(docs, size=3, p=90, q=100):
    """Per document: set size, smallest id that links lead to."""
    sets = []
    for _, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), (least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def top(rows, k=5, every=50):
    """rows: (id, vector). (query, rank, id, score) of each query."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return sorted(out)
