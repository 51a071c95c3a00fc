"""Ranked lexical search by hashed max-sketches.

The index holds a sketch for each document: its terms are hashed onto a power of two
of coordinates, about four a distinct term, and each coordinate keeps the largest
impact of its terms. Within a document the impact rises with the number of
occurrences alone, so the number is what is kept, in 8 bits, rounded up; the impact
follows from it and the document's length. A batch of queries looks up its terms'
coordinates in all sketches of a block at once: the weighted sum is an upper bound of
each document's score. Documents are scored exactly from their texts in descending
order of the bound, until the bound falls under the tenth score found so far. A first
round over a hash sample of the documents (SEED) gives every task of the second
round, which goes over all documents, a threshold to start from; the threshold is a
score that ten documents have, so the result is exact.

The term statistics (documents a term is in) are counted over all documents while
the sketches are made. Queries are taken in batches of bounded size, each of them a
pass over the sketches.

Defined results: a null or empty text has no terms, a query without terms has no
rows; a repeated document is one more document, a repeated query one more query;
equal scores are ranked by ascending doc_id, null last; an empty table gives an
empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize

#: Coordinates a distinct term, at least, and coordinates of a sketch, at least.
SPREAD, MIN_WIDTH = 4, 64
#: One document of so many is in the first round.
SEED = 64
#: Terms of the queries of one batch, about.
BATCH_TERMS = 16_000
#: A task hands its term statistics on when it holds this many terms.
MAX_COUNTED = 300_000
#: Scale of the scores.
ONE = 1_000_000_000

#: Bytes: ASCII letters are lower-cased, ASCII letters and digits and all bytes of other characters stay, the rest is a space.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _levels() -> np.ndarray:
    """The largest number of occurrences that each 8-bit level stands for: exact up to 127, then in steps of six percent; the last is more than a text can have."""
    out = list(range(128))
    while len(out) < 255:
        out.append(math.ceil(out[-1] * 1.06))
    return np.array([*out, 2**32], dtype=np.int64)


LEVELS = _levels()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_TERMS).split()


def impact(tf, m):
    return ONE * tf // (1000 * tf + 8 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 25 + 75 * n * n_docs // max(n_terms, 1)


def sketch(counts: Counter[bytes], spread: int = SPREAD, min_width: int = MIN_WIDTH) -> bytes:
    """The largest level of each coordinate's terms."""
    width = min_width
    while width < spread * len(counts):
        width *= 2
    out = np.zeros(width, dtype=np.uint8)
    at = np.fromiter(map(zlib.crc32, counts), dtype=np.int64, count=len(counts)) & (width - 1)
    np.maximum.at(out, at, np.searchsorted(LEVELS, np.fromiter(counts.values(), dtype=np.int64, count=len(counts))).astype(np.uint8))
    return out.tobytes()


def _index(batches: Iterator[dict[str, list]], spread: int, min_width: int, max_counted: int) -> Iterator[dict]:
    held: Counter[bytes] = Counter()

    def statistics() -> dict:
        none = [None] * len(held)
        return {"doc_id": none, "text": none, "n": none, "sketch": none, "term": list(held), "df": list(held.values())}

    for b in batches:
        n, sketches = [], []
        for text in b["text"]:
            counts = Counter(terms(text))
            n.append(counts.total())
            sketches.append(sketch(counts, spread, min_width))
            held.update(counts.keys())
        none = [None] * len(n)
        yield {"doc_id": b["doc_id"], "text": b["text"], "n": n, "sketch": sketches, "term": none, "df": none}
        if len(held) >= max_counted:
            yield statistics()
            held.clear()
    yield statistics()


@dataclass
class Index:
    """docs: (doc_id, text, n, sketch); frequencies: (term, df); n_docs with at least one term, and n_terms with repeats."""

    docs: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD, min_width: int = MIN_WIDTH, max_counted: int = MAX_COUNTED) -> Index:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    made = materialize(map_rows(rows, lambda batches: _index(batches, spread, min_width, max_counted), "doc_id long, text binary, n long, sketch binary, term binary, df long"), "search_index")
    kept = made.where(F.col("n") > 0).select("doc_id", "text", "n", "sketch")
    frequencies = materialize(made.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")), "search_frequencies")
    total = kept.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    return Index(kept, frequencies, total["docs"], total["terms"] or 0)


class Batch:
    """Queries of one batch: each as its terms with weight times repeats, and folded onto the coordinates of a sketch of any width."""

    def __init__(self, queries: dict[int, Counter[bytes]], weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.keys = list(queries)
        self.scored = [{t: c * weights[t] for t, c in queries[k].items() if weights.get(t)} for k in self.keys]
        self.terms = {t for q in self.scored for t in q}
        self.n_docs, self.n_terms = n_docs, n_terms
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates that the terms have in a sketch of that width, and the weight of each for each query."""
        if width not in self._folded:
            at = {t: zlib.crc32(t) & (width - 1) for t in self.terms}
            coordinates = np.array(sorted(set(at.values())), dtype=np.int64)
            row = {c: i for i, c in enumerate(coordinates.tolist())}
            weight = np.zeros((len(coordinates), len(self.keys)))
            for q, held in enumerate(self.scored):
                for t, w in held.items():
                    weight[row[at[t]], q] += w
            self._folded[width] = coordinates, weight
        return self._folded[width]

    def bounds(self, sketches: list[bytes], n: list[int]) -> np.ndarray:
        """An upper bound of the score of each document for each query. Sums stay under 2^53, so doubles are exact."""
        out = np.zeros((len(sketches), len(self.keys)))
        m = length_factor(np.array(n, dtype=np.int64), self.n_docs, self.n_terms)
        by_width = defaultdict(list)
        for i, s in enumerate(sketches):
            by_width[len(s)].append(i)
        for width, at in by_width.items():
            coordinates, weight = self.folded(width)
            levels = np.frombuffer(b"".join(sketches[i] for i in at), dtype=np.uint8).reshape(-1, width)[:, coordinates]
            out[at] = impact(LEVELS[levels], m[at][:, None]).astype(np.float64) @ weight
        return out

    def score(self, query: int, counts: Counter[bytes], m: int) -> int:
        return sum(w * impact(tf, m) for t, w in self.scored[query].items() if (tf := counts.get(t)))


def _best(batch: Batch, k: int, floor: dict[int, int]):
    """The map over index rows: the k best documents of the task for each query, none under the query's floor."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        best: list[list[tuple[int, float]]] = [[] for _ in batch.keys]  # heaps of (score, -doc_id)
        least = np.array([max(1, floor.get(q, 0)) for q in batch.keys], dtype=np.float64)
        for b in batches:
            bounds = batch.bounds(b["sketch"], b["n"])
            counts: dict[int, Counter[bytes]] = {}
            for q, heap in enumerate(best):
                reach = np.flatnonzero(bounds[:, q] >= least[q])
                for i in reach[np.argsort(-bounds[reach, q], kind="stable")].tolist():
                    if bounds[i, q] < least[q]:
                        break
                    if i not in counts:
                        counts[i] = Counter(t for t in terms(b["text"][i]) if t in batch.terms)
                    score = batch.score(q, counts[i], length_factor(b["n"][i], batch.n_docs, batch.n_terms))
                    found = (score, -math.inf if b["doc_id"][i] is None else -b["doc_id"][i])
                    if score < least[q] or len(heap) == k and found <= heap[0]:
                        continue
                    (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, found)
                    if len(heap) == k:
                        least[q] = max(least[q], heap[0][0])
        rows = [(key, None if d == -math.inf else -d, s) for key, heap in zip(batch.keys, best, strict=True) for s, d in heap]
        yield {"query": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]}

    return work


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_batch(index: Index, batch: Batch, k: int) -> DataFrame:
    """(query, rank, doc_id, score) of the k best documents of each query of the batch."""
    spark = index.docs.sparkSession

    def best(docs: DataFrame, floor: dict[int, int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((batch, floor))
        return _top(map_rows(docs, lambda rows: _best(shared.value[0], k, shared.value[1])(rows), "query long, doc_id long, score long"), k)

    seed = best(index.docs.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0), {})
    floor = {r["query"]: r["score"] for r in seed.where(F.col("rank") == k).select("query", "score").collect()}  # a row a query of the batch
    return best(index.docs, floor)


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest-scoring documents of each item, none of score 0."""
    schema = f"item_id {dict(items.dtypes)[item_id]}, rank int, doc_id long, score long"
    numbered = materialize(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("query")), "search_items")
    split = materialize(map_rows(numbered.select("query", "text"), _item_terms, "query long, term binary, c long"), "search_terms")
    known = materialize(split.join(index.frequencies, "term"), "search_terms")
    n_batches = -(-known.count() // batch_terms)
    out = []
    for i in range(n_batches):
        queries: dict[int, Counter[bytes]] = defaultdict(Counter)
        weights = {}
        for r in known.where(F.pmod(F.xxhash64("query"), F.lit(n_batches)) == i).toLocalIterator():  # about batch_terms rows
            term = bytes(r["term"])
            queries[r["query"]][term] = r["c"]
            weights[term] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))
        if queries:
            batch = Batch(dict(queries), weights, index.n_docs, index.n_terms)
            out.append(materialize(search_batch(index, batch, k), "search_found"))
    if not out:
        return items.sparkSession.createDataFrame([], schema)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
    for b in batches:
        rows = [(q, t, c) for q, text in zip(b["query"], b["text"], strict=True) for t, c in Counter(terms(text)).items()]
        yield {"query": [r[0] for r in rows], "term": [r[1] for r in rows], "c": [r[2] for r in rows]}


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    return search(build_index(docs), items, k)


ORACLE_SQL = r"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM dt WHERE len(t) > 0),
tf AS (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM dt),
c AS (SELECT doc_id, r, n, term, count(*) AS tf FROM tf GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, g GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN c USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
