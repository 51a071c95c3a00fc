"""Language-model scoring with a log-frequency Bloom filter.

Words (and the end of each text) and word pairs of the learning rows are counted
in Spark. The count n of a pair becomes the level 1 + floor(log2 n); the filter
holds each pair once for every level up to its own, so membership probes, level
by level until one fails, give its quantised count, 2^(level - 1): never more
than the true one. A probe tests BITS bits in each of WORDS 64-bit words. The
filter is sharded: the top bits of a pair's hash name its shard, which has
BITS_PER_ENTRY bits for each of its entries, so shards are built where their
pairs are shuffled to, and the false-positive rate does not depend on the
corpus. All counted pairs go in, those seen once too.

The model is a probability: with exact counts c of words, quantised counts q of
pairs and the base model b,

    p(w | u) = L * q(u, w) / (c(u) + false) + (1 - L) * b(w),    L = c(u) / (c(u) + PRIOR + false)

and b(w) after a word that was not learned. A word is followed by a token as
often as it occurs, so the q of a context add up to c(u) at most; `false` bounds
what false positives can add over the whole vocabulary, from the filter's measured
rate. So the probabilities after any context add up to 1 at most (less only by
quantising and `false`).

Texts too few to reach `max_bits` bits or `max_broadcast` words, however they read,
are scored with the filter and the counts as a broadcast, in segments by the top bits
of the hash, so that the driver never holds more than one. Beyond that, the n-grams of
a unit of texts are questions (`exchange`): they go once, with how often the unit's
learning rows have each, to the shard's task, which adds up the counts, fills the
shard and sends back a level for each pair and a count for each word. So the filter is
where it is asked, and n-grams are dealt out once for counting and scoring together.

Defined results: a null or empty text is its end token alone; a null doc_id is
in fold crc32('') and is scored like any other; repeated rows are learned from and
scored each; without learning rows every count is 0 (a score of 0 for the then
certain unknown token); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, SLICE_ROWS, fold_remainder, map_rows, materialize
from .exchange import Groups, ask, attach, expand, expand_keys, pack, part_count, rows, squeeze, unpack

WORDS, BITS = 3, 6
BITS_PER_ENTRY = 28
MAX_BITS = 1 << 31
#: The top bits of a hash that name its segment of the broadcast.
SEGMENT = 4
#: Filter shards a shuffle partition, at least.
SHARDS = 16
#: The weight of the base model, in tokens seen after a word.
PRIOR = 100.0
#: Tokens that are counted at once, and those that are scored at once, beside the filter in memory.
FLUSH_TOKENS = 300_000
SCORE_TOKENS = 80_000
#: Rows that a task gathers before it adds up the counts of equal n-grams.
MERGE_ROWS = 4_000_000
#: Words that a task remembers at once.
MAX_WORDS = 100_000
END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The lowest bit of an n-gram's hash tells pairs (1) from words (0).
_PAIR = np.uint64(1)


class Words(dict):
    """Numbers of the words that a task has met; number 0 is the end of a text."""

    def __init__(self):
        self.hashes = [END & ~1]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word) & ~1)
        return n


def chunks(batches, columns: tuple[str, ...], tokens: int = FLUSH_TOKENS):
    """(rows' other columns, words, numbers of all tokens, first token of each row) for chunks of about that many tokens.

    A text's tokens are its words and its end. The words are the same object until there are MAX_WORDS, then a new one.
    """
    known = Words()
    for b in batches:
        held, sizes, n, start = [], [], 0, 0
        for i, t in enumerate(b["text"]):
            words = (t or "").encode().lower().split()
            held.extend(map(known.__getitem__, words))
            held.append(0)
            sizes.append(len(words) + 1)
            n += len(words) + 1
            if n >= tokens or i + 1 == len(b["text"]):
                size = np.array(sizes)
                yield {c: b[c][start : i + 1] for c in columns}, known, np.array(held, np.int32), np.cumsum(size) - size
                held, sizes, n, start = [], [], 0, i + 1
                if len(known) > MAX_WORDS:
                    known = Words()


def pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; a text's first word follows an end."""
    x = np.empty_like(h)
    x[0], x[1:] = END & ~1, h[:-1]
    x *= _A
    x ^= (h << np.uint64(31)) | (h >> np.uint64(33))
    x ^= x >> np.uint64(29)
    x *= _B
    return x | _PAIR


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def _probes(h: np.ndarray, level: int, size: np.ndarray | int):
    """WORDS times: the positions of the keys' words at a level, within shards of `size` words, and hash bits that choose BITS bits of each."""
    x = (h ^ np.uint64(level * int(_A) & 2**64 - 1)) * _B
    for _ in range(WORDS):
        x = x ^ (x >> np.uint64(32))
        yield ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64), x
        x = (x + _A) * _C


def _mask(x: np.ndarray) -> np.ndarray:
    out = np.uint64(1) << (x & np.uint64(63))
    for i in range(1, BITS):
        out |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return out


def quantised(h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The quantised counts: the least count of the highest level whose probes, and those of all before it, succeed.

    A key's shard has `size` words from the index `start` of data on.
    """
    level, open_, k = np.zeros(len(h), np.int64), np.flatnonzero(size > 0), 1
    while len(open_) and k < 64:
        first, at = start[open_], np.arange(len(open_))
        for word, x in _probes(h[open_], k, size[open_]):
            mask = _mask(x[at])
            at = at[data[first[at] + word[at]] & mask == mask]
            if not len(at):
                break
        open_ = open_[at]
        level[open_] = k
        k += 1
    return np.where(level == 0, 0.0, 2.0 ** (level - 1))


def shard_bits(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words of a shard that holds these distinct pairs with their counts."""
    most = levels(n)
    size = -(-BITS_PER_ENTRY * int(most.sum()) // 64)
    bits = np.zeros(64 * size, np.uint8)
    for k in range(1, int(most.max(initial=0)) + 1):
        for word, x in _probes(h[most >= k], k, size):
            for i in range(BITS):
                bits[64 * word + (x >> np.uint64(6 * i) & np.uint64(63)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def false_rate(words: np.ndarray) -> float:
    """How likely a pair that is not there passes the first level's probes."""
    return float(np.mean((np.bitwise_count(words) / 64.0) ** BITS)) ** WORDS if len(words) else 0.0


def false_mass(n_words: int, rate: float) -> float:
    """A bound (mean and four deviations, at least one) of the counts that false positives add to a context over all words."""
    mean = n_words * rate
    return mean + 4 * math.sqrt(mean) + 1


class Filter:
    """Shards with numbers from `low` on, in order, laid end to end."""

    def __init__(self, shift: int, low: int, shards: list[tuple[int, bytes]]):
        self.shift, self.low = np.uint64(shift), low
        self.start, self.size = (np.zeros(1 << 64 - SEGMENT - shift, np.int64) for _ in range(2))
        for k, v in shards:
            self.size[k - low] = len(v) // 8
        self.start[1:] = np.cumsum(self.size)[:-1]
        self.words = np.frombuffer(b"".join(v for _, v in shards), "<u8")

    def counts(self, h: np.ndarray) -> np.ndarray:
        shard = (h >> self.shift).astype(np.int64) - self.low
        return quantised(h, self.words, self.start[shard], self.size[shard].astype(np.uint64))


def by_segment(h: np.ndarray, answer) -> np.ndarray:
    """answer(segment, hashes) for the hashes of each segment, in their places."""
    out, segment = np.zeros(len(h)), (h >> np.uint64(64 - SEGMENT)).astype(np.uint8)
    order = np.argsort(segment, kind="stable")
    edges = np.searchsorted(segment[order], np.arange((1 << SEGMENT) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        at = order[edges[k] : edges[k + 1]]
        out[at] = answer(k, h[at])
    return out


def count(docs: DataFrame) -> DataFrame:
    """(h, n) of words and pairs, counted within chunks: an n-gram has a row for each chunk that holds it."""
    def work(batches):
        totals, before = np.zeros(0, np.int64), None

        def flush():
            h = np.array(before.hashes[: len(totals)], np.uint64)
            some = totals > 0
            return {"h": h[some].view(np.int64), "n": totals[some]}

        for _, known, ids, _ in chunks(batches, ()):
            if before is not None and known is not before:
                yield flush()
                totals = np.zeros(0, np.int64)
            before = known
            n = np.bincount(ids, minlength=len(known.hashes))
            n[: len(totals)] += totals
            totals = n
            h, n = np.unique(pairs(np.array(known.hashes, np.uint64)[ids]), return_counts=True)
            yield {"h": h.view(np.int64), "n": n}
        if before is not None:
            yield flush()

    return map_rows(docs.select("text"), work, "h long, n long")


def _shards(spark: SparkSession) -> tuple[int, int]:
    """(shuffle partitions, the shift that leaves an n-gram's shard of its hash)"""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts, 64 - max(SEGMENT, min(20, (SHARDS * parts - 1).bit_length()))


def _merge(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    h, n = np.concatenate(h), np.concatenate(n)
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first) if len(h) else n


MODEL = pa.schema([("shard", pa.int32()), ("bits", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("false", pa.float64())])


def fill(counted: DataFrame) -> DataFrame:
    """One shuffle to the shards, written once. A row a shard: its filter words and their false-positive rate, its words' sorted hashes and their counts."""
    parts, shift = _shards(counted.sparkSession)

    def work(batches):
        held, rows, least = ([], []), 0, MERGE_ROWS
        for b in batches:
            held[0].append(b.column("h").to_numpy().view(np.uint64))
            held[1].append(b.column("n").to_numpy())
            rows += b.num_rows
            if rows >= least:
                h, n = _merge(*held)
                held, rows, least = ([h], [n]), len(h), len(h) + MERGE_ROWS
        if not rows:
            return
        h, n = _merge(*held)
        held, shard, pair = None, (h >> np.uint64(shift)).astype(np.int64), h & _PAIR == _PAIR
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            both = pair[a:b]
            bits, keys, counts = shard_bits(h[a:b][both], n[a:b][both]), h[a:b][~both], n[a:b][~both]
            row = shard[a], bits.tobytes(), keys.tobytes(), counts.tobytes(), len(keys), counts.sum(), bits.nbytes, false_rate(bits)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, MODEL.types, strict=True)], schema=MODEL)

    dealt = counted.repartition(parts, F.shiftrightunsigned("h", shift)).select("h", "n")
    return materialize(dealt.mapInArrow(work, "shard int, bits binary, keys binary, counts binary, n_words long, n_tokens long, n_bytes long, false double"), "model")


def load(model: DataFrame) -> Iterator[tuple[Filter, np.ndarray, np.ndarray]]:
    """The segments, one after the other: filter, sorted words, their counts. Each is read by a job of its own."""
    shift = _shards(model.sparkSession)[1]
    per = 1 << 64 - SEGMENT - shift
    for k in range(1 << SEGMENT):
        rows = sorted(model.where(F.col("shard").between(k * per, (k + 1) * per - 1)).select("shard", "bits", "keys", "counts").collect())
        keys, counts = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
        yield Filter(shift, k * per, [(r["shard"], r["bits"]) for r in rows]), keys, counts.astype(np.uint32) if counts.max(initial=0) < 2**32 else counts


def _lookup(keys: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number at each hash among the sorted keys, 0 where it is none."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[k] == h, n[k].astype(np.int64), 0)


def _log_p(c: np.ndarray, before: np.ndarray, both: np.ndarray, floor: float, prior: float, false: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's base and model probability by the counts of the token, the one before it and the pair."""
    base = (c + 0.1) / floor
    share = before / (before + prior + false)
    return np.log10(base), np.log10(share * both / (before + false) + (1 - share) * base)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first)


def lm_scores(docs: DataFrame, folds: int = 10, held_out: int = 0, prior: float = PRIOR, max_broadcast: int = MAX_BROADCAST_ROWS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind, learned = dict(docs.dtypes)["doc_id"], fold_remainder(F.col("doc_id"), folds) != held_out
    units = pack(docs.select("doc_id", "text", learned.alias("learned")))
    most = (units.agg(F.sum("size")).first()[0] or 0) // 2  # a token takes two bytes, or is the end of a row
    near = most <= max_broadcast and BITS_PER_ENTRY * most <= max_bits
    built = fill(count(docs.where(learned))).withColumn("n_shards", F.lit(1)) if near else answered(units)
    total = built.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("words"), (F.sum("false") / F.sum("n_shards")).alias("rate")).first()
    n_all, n_words = total["n"] or 0, total["words"] or 0
    floor, false = n_all + 0.1 * (n_words + 1), false_mass(n_words, total["rate"] or 0.0)
    scored = near_scores(docs, built, floor, prior, false) if near else far_scores(attach(units, {"given": built.where("unit IS NOT NULL")}, max_broadcast), docs, floor, prior, false)
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), (fold_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


SCORES = "n_tokens long, n_known long, base_score double, score double"


def near_scores(docs: DataFrame, built: DataFrame, floor: float, prior: float, false: float) -> DataFrame:
    """(doc_id, SCORES) by a broadcast filter and word counts."""
    model = [docs.sparkSession.sparkContext.broadcast(x) for x in load(built)]

    def work(batches):
        known_count = lambda k, h: _lookup(*model[k].value[1:], h)
        pair_count = lambda k, h: model[k].value[0].counts(h)
        before, h, c = None, np.zeros(0, np.uint64), np.zeros(0)
        for rows, known, ids, first in chunks(batches, ("doc_id",), SCORE_TOKENS):
            if known is not before:
                before, h, c = known, h[:0], c[:0]
            new = np.array(known.hashes[len(h) :], np.uint64)
            h, c = np.concatenate([h, new]), np.concatenate([c, by_segment(new, known_count)])
            own, prev = c[ids], c[np.concatenate([[0], ids[:-1]])]  # a text's first token follows the end of the one before
            both, at = np.zeros(len(ids)), np.flatnonzero((own > 0) & (prev > 0))
            both[at] = by_segment(pairs(h[ids])[at], pair_count)
            base, score = _log_p(own, prev, both, floor, prior, false)
            yield rows | {"n_tokens": np.diff(np.append(first, len(ids))), "n_known": _sums((own > 0).astype(np.int64), first), "base_score": _sums(base, first), "score": _sums(score, first)}

    return map_rows(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCORES}")


class Unit:
    """A unit's texts as numbers of words, and its distinct n-grams."""

    def __init__(self, data: bytes):
        table, before, both = unpack(data), None, []
        self.docs, self.chunks, self.words = table["doc_id"], [], []
        batches = (b.to_pydict() for b in table.select(["text", "learned"]).to_batches(SLICE_ROWS))
        for learned, known, ids, first in chunks(batches, ("learned",)):
            if known is not before:
                before = known
                self.words.append(np.zeros(0, np.uint64))
            h = np.concatenate([self.words[-1], np.array(known.hashes[len(self.words[-1]) :], np.uint64)])
            self.words[-1] = h
            self.chunks.append((learned["learned"], len(self.words) - 1, ids, first))
            both.append(pairs(h[ids]))
        self.at = np.cumsum([0, *map(len, both), *map(len, self.words)])
        h = np.concatenate([*both, *self.words])
        both.clear()
        self.grams = Groups(h)

    def counts(self) -> np.ndarray:
        """How often the learning rows have each n-gram."""
        taken = [np.repeat(np.array(learned, bool), np.diff(np.append(first, len(ids)))) for learned, _, ids, first in self.chunks]
        own = [sum(np.bincount(ids[t], minlength=len(w)) for (_, k, ids, _), t in zip(self.chunks, taken, strict=True) if k == i) for i, w in enumerate(self.words)]
        return self.grams.fold(np.add, np.concatenate([*taken, *own]).astype(np.int64))

    def each(self, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(values of the tokens, of those before them, of their pairs; first token of each row) of each chunk, by the n-grams' values."""
        found = [value[self.grams.of[a:b]] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        for (_, k, ids, first), both in zip(self.chunks, found, strict=False):
            c = found[len(self.chunks) + k]
            yield c[ids], c[np.concatenate([[0], ids[:-1]])], both, first  # a text's first token follows the end of the one before


GIVEN = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_shards", pa.int64()), ("false", pa.float64())])


def answered(units: DataFrame) -> DataFrame:
    """For each unit and range its pairs' levels and its words' counts; without a unit, what fill() gives of the range's shards, added up. Written once."""
    shift, parts = _shards(units.sparkSession)[1], part_count(units)

    def questions(row):
        unit = Unit(row["data"])
        return [(unit.grams.keys, unit.counts())]

    def answer(batches):
        held = list(rows(batches))
        if not held:
            return
        keys = [expand_keys(r["keys"]) for r in held]
        grams = Groups(np.concatenate(keys))
        h, n = grams.keys, grams.fold(np.add, np.concatenate([expand(r["numbers"], np.int64) for r in held]))
        shard, pair, stats = (h >> np.uint64(shift)).astype(np.int64), h & _PAIR == _PAIR, [0, 0, 0, 0.0]
        value = np.where(pair, 0, n)
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(at[:-1], at[1:], strict=True):
            own, c = h[a:b], n[a:b]
            if not c.any():
                continue
            both, word = np.flatnonzero(pair[a:b]), (c > 0) & ~pair[a:b]
            learned = both[c[both] > 0]
            bits = shard_bits(own[learned], c[learned])
            q = quantised(own[both], bits, np.zeros(len(both), np.int64), np.full(len(both), len(bits), np.uint64))
            value[a + both] = np.where(q > 0, np.log2(np.maximum(q, 1)) + 1, 0)
            stats = [x + y for x, y in zip(stats, (int(word.sum()), int(c[word].sum()), 1, false_rate(bits)), strict=True)]
        out = [(None, None, None, None, None, *stats)]
        for r, k, v in zip(held, keys, np.split(value[grams.of], np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            both = k & _PAIR == _PAIR
            out.append((r["unit"], r["kind"], r["part"], squeeze(v[both].astype(np.uint8)), squeeze(v[~both]), None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), GIVEN.types, strict=True)], schema=GIVEN)

    asked = ask(units, questions, parts, shift)
    return materialize(asked.mapInArrow(answer, "unit long, kind int, part int, levels binary, counts binary, n_words long, n_tokens long, n_shards long, false double"), "answers")


def far_scores(units: DataFrame, docs: DataFrame, floor: float, prior: float, false: float) -> DataFrame:
    """(doc_id, SCORES) of units with the answers to their questions."""
    def score(batches):
        for row in rows(batches):
            unit, given = Unit(row["data"]), row["given"] or ()
            pair = unit.grams.keys & _PAIR == _PAIR
            level, value = (np.concatenate([np.zeros(0, t), *(expand(x[c], t) for x in given)]) for c, t in (("levels", np.uint8), ("counts", np.int64)))
            if len(level) + len(value) != len(pair):
                raise RuntimeError(f"{len(level) + len(value)} of {len(pair)} n-grams have an answer")
            c = np.empty(len(pair))
            c[pair], c[~pair] = np.where(level > 0, 2.0 ** (level - 1.0), 0.0), value
            out = []
            for own, prev, both, first in unit.each(c):
                base, each = _log_p(own, prev, np.where((own > 0) & (prev > 0), both, 0.0), floor, prior, false)
                out.append((np.diff(np.append(first, len(own))), _sums((own > 0).astype(np.int64), first), _sums(base, first), _sums(each, first)))
            yield pa.RecordBatch.from_arrays([unit.docs.combine_chunks(), *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
            unit = given = c = out = None  # before the next one is in memory

    return units.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCORES}")
