"""Language ID by nearest centroid.

A text's vector holds its hashed byte trigrams, sublinear counts times inverse
document frequency, of length one. Document frequencies come from every learning
row; each language's few centroids come from spherical k-means over a bounded
sample of its rows, fitted on executors, one group a language. A text gets the
language of the centroid with the largest cosine, and is rejected if it is further
from that centroid than all but REJECT of the sampled texts that the centroid is
made of.

Defined results: null text and text without a letter are `und` with score 0; a
null lang or doc_id is not learned from; repeated rows are learned from and
predicted each; without learning rows every text is `und`; ties go to the
alphabetically first language; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, map_rows

DIMENSIONS = 4096
#: Rows of a language that its centroids are fitted on, about (a binomial number): those whose id's hash is below the share that this is of its rows.
SAMPLE_ROWS = 1_000
CENTROIDS = 4
#: The share of a centroid's own texts that are further away than its radius.
REJECT = 0.01
LETTER = re.compile(r"[^\W\d_]")

#: Letters and bytes over 127 stand for themselves, all else for a space.
_KIND = np.full(256, 32, np.uint32)
_KIND[97:123], _KIND[128:] = np.arange(97, 123), np.arange(128, 256)


def counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text: at most DIMENSIONS counts."""
    b = _KIND[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    if len(b) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    key = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(20), minlength=DIMENSIONS).astype(np.float32)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from rows far from each other."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, 1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, 1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    #: Of each centroid: its language, the vector, the least cosine of its own texts.
    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> Model:
    """Fits the centroids; only document frequencies and centroids reach the driver."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_remainder(F.col("doc_id"), folds) != held_out))

    def presence(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                seen += counts(t) > 0
                n += 1
        yield {"dimension": [*range(DIMENSIONS), -1], "n": [*seen.tolist(), n]}

    found = {r["dimension"]: r["n"] for r in map_rows(rows.select("text"), presence, "dimension int, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    idf = np.log((1.0 + n) / (1.0 + np.array([found.get(i, 0) for i in range(DIMENSIONS)]))).astype(np.float32) + 1
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))  # a row a language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").where(draw * F.col("n_lang") < sample_rows).select("doc_id", "lang", "text")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array([vector(t, idf) for t in group.sort_values(["doc_id", "text"])["text"]])
        c = cluster(x, k).astype(np.float32)
        near = x @ c.T
        own = np.argmax(near, 1)
        radius = [float(np.quantile(near[own == i, i], REJECT)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [v.tobytes() for v in c], "radius": radius})

    fitted = sorted((r["lang"], bytes(r["centroid"]), r["radius"]) for r in sample.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, radius double").collect())
    centroids = np.array([np.frombuffer(c, np.float32) for _, c, _ in fitted]).reshape(-1, DIMENSIONS)
    return Model([lang for lang, _, _ in fitted], centroids, np.array([r for _, _, r in fitted]), idf)


def predict(texts: Iterable[str | None], model: Model) -> Iterator[tuple[str, float, bool]]:
    """(language, cosine in 0..1, whether it is rejected) of each text."""
    for t in texts:
        if not t or not model.langs or not LETTER.search(t):
            yield "und", 0.0, True
            continue
        near = model.centroids @ vector(t, model.idf)
        best = int(np.argmax(near))
        yield model.langs[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < model.radius[best])


def language_ids(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, folds, held_out))  # CENTROIDS vectors a language

    def work(batches):
        for b in batches:
            found = list(predict(b["text"], model.value))
            yield {"doc_id": b["doc_id"], "lang_pred": [x for x, _, _ in found], "score": [s for _, s, _ in found], "rejected": [r for _, _, r in found]}

    out = map_rows(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
