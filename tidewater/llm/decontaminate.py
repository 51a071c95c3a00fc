"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-cased words with single spaces. If an item of m
bytes stands in a document with at most e edits, at least m - q + 1 - q * e of
its q-grams stand there too, on diagonals (document position minus item
position) that differ by at most e. Shared q-grams are counted in diagonal bands
of width 2 * (e + 1) that overlap by half; a band that reaches the bound is a
region, and a banded alignment decides. q-grams that many items share count only
for items that would lose their bound without them; the lemma holds for any
subset of an item's q-grams. q is Q bytes, or less for a short item, so that the
bound is at least 1.

An item so short that its edit budget is 0 is found as it is, as whole words.

Defined results: null or empty texts match nothing; equal items all match; repeated rows match
alike; a null doc_id keeps its matches under null; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, restrict

#: Bytes of a q-gram, at most.
Q = 8
ERROR_RATE = 0.1
#: Items are searched for in blocks of at most this many bytes, each a broadcast index of some 30 bytes a byte.
BLOCK_BYTES = 4_000_000
COMMON = 4
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LUT_BITS = 22


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_TABLE).split())


def gram_size(length: int, budget: int) -> int:
    """The q of an item: length - q + 1 - q * budget, the least number of shared q-grams, is at least 1."""
    return min(Q, length // (budget + 1))


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """The q bytes from each position on, as integers."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(data + bytes(8 - q), np.uint8), (len(data) - q + 1, 8), (1, 1)).copy().view("<u8").ravel()
    return eight & np.uint64((1 << 8 * q) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _LUT_BITS)).astype(np.int64)


class Grams:
    """The q-grams of the items of one q."""

    def __init__(self, q: int, items: list[tuple[int, bytes, int]]):
        self.q, self.ids, self.data = q, [i for i, _, _ in items], [d for _, d, _ in items]
        self.budget = np.array([e for _, _, e in items], np.int64)
        all_grams = [grams(d, q) for d in self.data]
        gram = np.concatenate(all_grams)
        item = np.repeat(np.arange(len(items)), [len(g) for g in all_grams])
        pos = np.concatenate([np.arange(len(g)) for g in all_grams])
        pairs = np.unique(np.rec.fromarrays([gram, item]))
        key, share = np.unique(pairs["f0"], return_counts=True)
        rare = share[np.searchsorted(key, gram)] <= COMMON
        n_all, n_rare = (np.bincount(item, w, len(items)).astype(np.int64) for w in (None, rare))
        enough = n_rare - q * self.budget >= 4
        self.least = np.maximum(1, np.where(enough, n_rare, n_all) - q * self.budget)
        use = rare | ~enough[item]
        order = np.argsort(gram[use], kind="stable")
        gram, self.item, self.pos = gram[use][order], item[use][order], pos[use][order]
        self.keys, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)
        self.lut = np.zeros(1 << _LUT_BITS, bool)
        self.lut[_slot(self.keys)] = True

    def regions(self, doc: bytes) -> list[tuple[int, int]]:
        """(item index, lowest diagonal) of each band that reaches its bound."""
        g = grams(doc, self.q)
        if not len(g):
            return []
        at = np.flatnonzero(self.lut[_slot(g)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[k] == g[at]
        at, k = at[real], k[real]
        n = self.count[k]
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(k) else np.empty(0, np.int64)
        item, diagonal = self.item[entry], np.repeat(at, n) - self.pos[entry]
        width = self.budget[item] + 1
        band = diagonal // width
        span = len(doc) + max(map(len, self.data)) + 2
        both = np.concatenate([item * (4 * span) + band + span, item * (4 * span) + band - 1 + span])
        key, count = np.unique(both, return_counts=True)
        item, band = key // (4 * span), key % (4 * span) - span
        full = count >= self.least[item]
        return [(int(i), int(b) * int(self.budget[i] + 1)) for i, b in zip(item[full], band[full], strict=True)]

    def matches(self, doc: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the best verified region of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for i, low in self.regions(doc):
            e = int(self.budget[i])
            start = max(0, low)
            end = min(len(doc), low + 2 * (e + 1) + len(self.data[i]) + e)
            found = align(self.data[i], doc[start:end], e, low - start)
            if found is not None and (i not in best or found[2] < best[i][2]):
                best[i] = found[0] + start, found[1] + start, found[2]
        return [(self.ids[i], *v) for i, v in best.items()]


class Index:
    """A block of items: their q-grams by q, and the items without an edit budget by their word that the fewest of those items have."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        every = [(i, d, math.floor(rate * len(d))) for i, t in items if (d := folded(t))]
        by_q: dict[int, list[tuple[int, bytes, int]]] = defaultdict(list)
        for i, d, e in every:
            if e:
                by_q[gram_size(len(d), e)].append((i, d, e))
        self.parts = [Grams(q, held) for q, held in sorted(by_q.items())]
        self.data, self.budget = [d for p in self.parts for d in p.data], [int(e) for p in self.parts for e in p.budget]
        plain = [(i, d, set(d.split())) for i, d, e in every if not e]
        uses = Counter(w for _, _, words in plain for w in words)
        self.plain: dict[bytes, list[tuple[int, bytes]]] = defaultdict(list)
        for i, d, words in plain:
            self.plain[min(words, key=lambda w: (uses[w], w))].append((i, b" %b " % d))

    def matches(self, doc: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the best place of each item."""
        return [m for part in self.parts for m in part.matches(doc)] + self.exact(doc)

    def exact(self, doc: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, 0) of the first place of each item without an edit budget."""
        if not self.plain:
            return []
        spaced = b" %b " % doc
        return [(i, at, at + len(d) - 2, 0) for w in self.plain.keys() & set(doc.split()) for i, d in self.plain[w] if (at := spaced.find(d)) >= 0]


def align(item: bytes, window: bytes, budget: int, low: int = 0) -> tuple[int, int, int] | None:
    """(start, end, edits) of the item in the window, if at most budget edits lead to it; low: the band's lowest diagonal there.

    A row of the band holds the diagonals from low - budget to low + 3 * budget + 2; the start of the alignment is free.
    """
    at = window.find(item)
    if at >= 0:
        return at, at + len(item), 0
    width, inf = 4 * budget + 3, budget + 1
    base = low - budget
    text = np.frombuffer(window, np.uint8)
    diagonal = np.arange(width)
    inside = lambda j: (j >= 0) & (j <= len(text))
    cost = np.where(inside(base + diagonal), 0, inf)
    begin = base + diagonal
    for i in range(1, len(item) + 1):
        j = base + diagonal + i  # text bytes used
        ok = inside(j)
        same = np.zeros(width, bool)
        real = (j >= 1) & (j <= len(text))
        same[real] = text[j[real] - 1] == item[i - 1]
        change = np.where(real, cost + ~same, inf)
        skip = np.append(cost[1:] + 1, inf)  # an item byte without a text byte: from the next diagonal
        new = np.minimum(change, skip)
        origin = np.where(change <= skip, begin, np.append(begin[1:], 0))
        chain = np.minimum.accumulate(new - diagonal) + diagonal  # text bytes without an item byte
        source = np.maximum.accumulate(np.where(new - diagonal == np.minimum.accumulate(new - diagonal), diagonal, 0))
        cost, begin = np.where(ok, np.minimum(chain, inf), inf), origin[source]
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(begin[k]), int(base + k + len(item)), int(cost[k])


#: The index that this Python worker has built last, with the name of its block: a worker's tasks share it.
_built: tuple[str, Index] | None = None


def _index_of(name: str, items: list[tuple[int, str]], rate: float) -> Index:
    global _built
    if _built is None or _built[0] != name:
        _built = None
        _built = name, Index(items, rate)
    return _built[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each benchmark item that stands in a document, positions in the folded text."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    found = None
    for k in range(blocks):
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches, shared=shared, name=uuid.uuid4().hex):
            index = _index_of(name, shared.value, rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b["doc_id"], b["text"], strict=True) for m in index.matches(folded(t))]
                yield {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "item_id", "start", "end", "edits"))}

        part = map_rows(docs.select("doc_id", "text"), work, f"doc_id {kind}, item_id {dict(benchmark.dtypes)['item_id']}, start long, end long, edits int")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold a benchmark item; all columns kept. Only the ids of the others are joined."""
    key = free_name(docs, "__leak_row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    hits = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, rate, block_bytes=block_bytes)
    return restrict(keyed, hits.select(F.col("doc_id").alias(key)).distinct(), "left_anti").drop(key)
