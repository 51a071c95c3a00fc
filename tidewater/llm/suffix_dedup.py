"""Repeated passages: which bytes are covered by a string of `length` bytes that also starts in an earlier document.

A suffix array of the corpus brings equal suffixes together; its intervals of
common prefix `length` are the groups of equal strings of that length. Sorting
every suffix costs over a microsecond a byte, so suffixes are first thinned
without loss: of the K-grams of each string of `length` bytes the one with the
smallest hash is its anchor, so equal strings have equal anchors.

1. A run is a stretch of neighbouring strings with one anchor. Runs whose anchor
   stands in at least two documents are kept.
2. A run's context is all bytes of its strings. Of equal contexts the smallest
   document is the source, all others are covered. Interiors of long repeats end here.
3. At the edges of repeats contexts differ. There the strings of the first run of
   each context are the suffixes: each string's smallest document is its source.

The three are questions that units of documents have about all others (`exchange`):
whether an anchor is elsewhere, whether it has other contexts, whether a smaller
document has a context or a string. What comes back is a bit a question, so no table
of groups stands on the driver, and a passage in a third of all documents gathers
nowhere. Exact copies are found by the text's digest first; only the first of them
takes part. The join that finds them deals the copies of a text into SALTS parts.

Defined results: null and empty texts have no bytes; a text shorter than
`length` loses nothing; a null doc_id comes after all others; rows of equal doc_id
are one document and do not cover each other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .exchange import Groups, Question, answers, ask, attach, differing, earlier, elsewhere, pack, part_count, recall, rows, unpack

LENGTH = 50
K = 24
LAST = 2**63 - 1
#: The bits of an anchor's hash that are asked for: anchors that differ in others are looked at in vain, and nothing is lost.
ANCHOR = ~np.uint64(2**20 - 1)
#: Bytes of text that are looked at together.
CHUNK = 500_000
#: Parts that the copies of one text are dealt into when they are joined to the first of them.
SALTS = 16
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def _mix(parts: Iterable[np.ndarray]) -> np.ndarray:
    h = np.uint64(0)
    for p in parts:
        h = (h ^ p) * _A
        h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours: of 2, 4, 8, ... first."""
    span = 1
    while 2 * span <= w:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (w - span)], x[w - span :])


class Chunk:
    """Texts laid end to end, so that a few array operations serve many documents; no string crosses from one to the next."""

    def __init__(self, raw: bytes, end: np.ndarray, docs: np.ndarray):
        self.raw, self.end, self.docs = raw, end, docs
        self.data = np.frombuffer(raw, np.uint8)
        self.start = np.concatenate([[0], end[:-1]])

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The document of each position."""
        return self.docs[np.searchsorted(self.end, at, "right")]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's hash, first start, last start) of each stretch of a text's strings whose smallest K-gram hash is the same."""
        if len(self.data) < length:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        g = _loads(self.data)
        h = g[: -(K - 8)] * _A
        h += g[8 : len(g) - (K - 16)] * _B
        h += g[16:] * _C
        h ^= h >> np.uint64(31)
        h *= _A
        h ^= h >> np.uint64(29)
        least = _least(h, length - K + 1)
        valid = np.zeros(len(least) + 1, np.int8)
        real = self.end - self.start >= length
        begin, stop = self.start[real], self.end[real] - length + 1
        np.add.at(valid, begin, 1)
        np.add.at(valid, stop, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        new[begin] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(least)) - 1
        return least[first], first, np.minimum(last, self.end[np.searchsorted(self.end, first, "right")] - length)


def contexts(raw: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of all bytes of each run's strings."""
    return np.array([xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All starts of the runs."""
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def strings(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hashes of the strings of `length` bytes that start at the positions."""
    if not len(at):
        return np.empty(0, np.uint64)
    g = _loads(data)
    return _mix([g[at + i] for i in [*range(0, length - 7, 8), length - 8]] + [np.uint64(length)])


class Unit:
    """A unit's texts in chunks of about CHUNK bytes, and the runs of all of them: anchor, first start, last start, document."""

    def __init__(self, row: dict, parts: int, length: int):
        self.row, self.parts, self.length = row, parts, length
        table = unpack(row["data"])
        text, docs = table["text"].combine_chunks(), table["doc"].to_numpy()
        text = text.cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2] or b""
        cuts = np.flatnonzero(np.diff((ends[1:] - ends[0]) // CHUNK, prepend=-1, append=-1)) if len(text) else np.zeros(1, np.int64)
        cuts = np.unique(np.concatenate([[0], cuts, [len(text)]]))
        self.chunks = [Chunk(bytes(raw[ends[i] : ends[j]]), ends[i + 1 : j + 1] - ends[i], docs[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        found = [c.runs(length) for c in self.chunks]
        self.at = np.cumsum([0, *(len(x[0]) for x in found)])
        join = lambda i, kind: np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind)
        self.h, self.a, self.b = join(0, np.uint64) * _A & ANCHOR, join(1, np.int64), join(2, np.int64)  # the least hashes are small: spread over all ranges
        self.doc = np.concatenate([c.doc(x[1]) for c, x in zip(self.chunks, found, strict=True)]) if found else np.zeros(0, np.int64)

    def each(self, chosen: np.ndarray) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
        """(chunk, first and last starts) of the chosen runs."""
        for c, i, j in zip(self.chunks, self.at[:-1], self.at[1:], strict=True):
            own = np.flatnonzero(chosen[i:j]) + i
            yield c, self.a[own], self.b[own]

    def anchors(self) -> list[Question]:
        """Round 1: anchors, and whether two documents of the unit have one."""
        self.by_anchor = Groups(self.h)
        two = self.by_anchor.fold(np.minimum, self.doc) < self.by_anchor.fold(np.maximum, self.doc)
        return [(self.by_anchor.keys, two.astype(np.int64))]

    def contexts(self) -> list[Question]:
        """Round 2: for runs with a shared anchor, the anchors with their least and greatest context, and the contexts with their smallest document."""
        (keys, _), = self.anchors()
        self.shared = recall(self.row["shared"], 0, keys, self.parts)[self.by_anchor.of]
        self.context = np.concatenate([np.zeros(0, np.uint64), *(contexts(c.raw, a, b, self.length) for c, a, b in self.each(self.shared))])
        g = self.by_shared = Groups(self.h[self.shared])
        low, high = g.fold(np.minimum, _signed(self.context)), g.fold(np.maximum, _signed(self.context))
        order = np.argsort(np.concatenate([g.keys, g.keys[low < high]]), kind="stable")
        self.by_context = Groups(self.context)
        self.least = self.by_context.fold(np.minimum, self.doc[self.shared])
        return [(np.concatenate([g.keys, g.keys[low < high]])[order], np.concatenate([low, high[low < high]])[order]), (self.by_context.keys, self.least)]

    def strings(self) -> list[Question]:
        """Round 3: the strings of runs that no earlier document has whole and whose anchor has several contexts, with their smallest document."""
        (asked, _), (keys, _) = self.contexts()
        own = self.doc[self.shared]
        before = recall(self.row["whole"], 1, keys, self.parts)[self.by_context.of] | (self.least[self.by_context.of] < own)
        mixed = recall(self.row["whole"], 0, asked, self.parts)[np.searchsorted(asked, self.by_shared.keys)][self.by_shared.of]
        self.whole, self.open = np.zeros(len(self.h), bool), np.zeros(len(self.h), bool)
        self.whole[self.shared], self.open[self.shared] = before, ~before & mixed
        self.starts = [spread(a, b) for _, a, b in self.each(self.open)]
        self.by_string = Groups(np.concatenate([np.zeros(0, np.uint64), *(strings(c.data, x, self.length) for c, x in zip(self.chunks, self.starts, strict=True))]))
        self.holder = np.concatenate([np.zeros(0, np.int64), *(c.doc(x) for c, x in zip(self.chunks, self.starts, strict=True))])
        self.first = self.by_string.fold(np.minimum, self.holder)
        return [(self.by_string.keys, self.first)]

    def covered(self) -> Iterator[tuple[Chunk, np.ndarray]]:
        """Each chunk, and which of its bytes an earlier document covers."""
        (keys, _), = self.strings()
        before = recall(self.row["ends"], 0, keys, self.parts)[self.by_string.of] | (self.first[self.by_string.of] < self.holder)
        at = 0
        for (c, a, b), starts in zip(self.each(self.whole), self.starts, strict=True):
            own = starts[before[at : at + len(starts)]]
            at += len(starts)
            n = len(c.data) + 1
            change = np.bincount(np.concatenate([a, own]), minlength=n) - np.bincount(np.concatenate([b, own]) + self.length, minlength=n)
            yield c, np.cumsum(change[:-1]) > 0


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def answered(docs: DataFrame, length: int = LENGTH, limit: int | None = None) -> tuple[DataFrame, int]:
    """Rows (doc, text) in units, with the answers to the questions of all three rounds; the number of ranges."""
    units = pack(docs)
    parts, given = part_count(units), {}
    for name, questions, judges in (("shared", Unit.anchors, [elsewhere]), ("whole", Unit.contexts, [differing, earlier]), ("ends", Unit.strings, [earlier])):
        asked = ask(attach(units, given, limit), lambda row, q=questions: q(Unit(row, parts, length)), parts)
        given[name] = answers(asked, judges)
    return attach(units, given, limit), parts


def remove_repeats(docs: DataFrame, length: int = LENGTH, limit: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST - 1)).alias("doc"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    texts = keyed.select("doc", digest.alias("digest"))
    several = texts.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first")
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = salted.join(several, ["digest", "salt"]).where(F.col("doc") > F.col("first")).select("doc", F.xxhash64("digest").alias("version"), F.lit(True).alias("copy")).distinct()
    copies, few = bounded(copies, limit)
    keyed = keyed.withColumn("version", F.xxhash64(digest)).join(F.broadcast(copies) if few else copies, ["doc", "version"], "left")
    rest = keyed.where(F.col("copy")).select("doc_id", "text")
    units, parts = answered(keyed.where(F.col("copy").isNull()).select("doc", "text"), length, limit)
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches):
        for row in rows(batches):
            for chunk, gone in Unit(row, parts, length).covered():
                kept = [chunk.data[a:b][~gone[a:b]].tobytes() for a, b in zip(chunk.start.tolist(), chunk.end.tolist(), strict=True)]
                size = chunk.end - chunk.start
                opened = gone.copy()
                opened[1:] &= ~gone[:-1]
                opened[chunk.start[size > 0]] = gone[chunk.start[size > 0]]
                spans = np.concatenate([[0], np.cumsum(opened)])
                columns = chunk.docs, size, size - [len(x) for x in kept], spans[chunk.end] - spans[chunk.start], kept
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    own_id = F.when(F.col("doc") != LAST - 1, F.col("doc")).cast(kind).alias("doc_id")
    kept = units.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").select(own_id, "n_bytes", "n_removed", "n_spans", "kept")
    n = F.octet_length("text").cast("long")
    all_gone = n >= length
    copied = rest.select("doc_id", n.alias("n_bytes"), F.when(all_gone, n).otherwise(0).cast("long").alias("n_removed"), F.when(all_gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(all_gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"))
    return kept.unionByName(copied)


def repeats_digest(docs: DataFrame, length: int = LENGTH, limit: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, length, limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
