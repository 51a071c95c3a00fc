"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and full-width letters to Latin ones and
digits or signs that stand for letters to those letters. The lexicon is learned
from a bounded sample of labelled rows: words and word beginnings that are much
likelier in toxic documents, weighted by log odds; of those at one place the
heaviest counts. A hit inside an exception phrase (the term with
a neighbouring word, learned from non-toxic documents, or given) does not
count. The score is a logistic function of the hits' weight, normalised by the
square root of the text's words, and of whether there is any hit.

Defined results: null or empty text scores as no hits; a label or doc_id that is
null is not learned from; repeated rows count once in learning and are each
scored; without labelled rows of both kinds the lexicon is empty and every score
is the share of toxic labels (0 without labels); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, map_rows, materialize

#: Look-alike letters of other scripts, and digits or signs read as letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Rows that the lexicon may be learned from: the labelled rows with the smallest hashes.
SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6)
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
FOLDED = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower()
    return text.translate(FOLDED)


def _terms(words: list[str]) -> set[str]:
    """The words, and as stem* their beginnings of STEMS letters: insults come in many forms."""
    own = set(words)
    return own | {f"{w[:k]}*" for w in own for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    prior: float = 0.0
    #: Bias, and the factors of the normalised weight and of any hit.
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _of(self, stem: str) -> tuple[float, float]:
        """The weights of the word itself and of any word that begins with it."""
        return self.weights.get(stem, 0.0), self.weights.get(f"{stem}*", 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            stem = term.rstrip("*")
            found.add_word(stem, (len(stem), *self._of(stem)))
        found.make_automaton()
        return found


def _word_before(folded: str, start: int) -> str:
    while start and not folded[start - 1].isalpha():
        start -= 1
    end = start
    while start and folded[start - 1].isalpha():
        start -= 1
    return folded[start:end]


def features(text: str, lexicon: Lexicon, automaton) -> tuple[float, float]:
    """The hits' weight over the square root of the words, and whether there is a hit."""
    folded = fold(text)
    hits: dict[int, float] = {}  # the heaviest term at each word's start
    n = len(folded)
    for end, (length, whole, stem) in automaton.iter(folded) if lexicon.weights else ():
        start = end + 1 - length
        if start and folded[start - 1].isalpha():
            continue
        weight = stem if end + 1 < n and folded[end + 1].isalpha() else max(whole, stem)
        if weight <= hits.get(start, 0.0):
            continue
        if lexicon.exceptions:
            own = LETTERS.match(folded, start)[0]
            after = LETTERS.search(folded, start + len(own))
            if f"{_word_before(folded, start)} {own}" in lexicon.exceptions or after and f"{own} {after[0]}" in lexicon.exceptions:
                continue
        hits[start] = weight
    total = sum(hits.values())
    words = max(1, len(text.split()))
    return total / math.sqrt(words), float(total > 0)


def _probability(x: tuple[float, float], lexicon: Lexicon) -> float:
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic curve over at most SAMPLE_ROWS rows."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, exceptions: frozenset[str] = frozenset(), folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, min_share: float = 0.02, min_lift: float = 20.0) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fold.

    A term enters if at least min_share of the toxic sample holds it and it is min_lift times likelier there. Near copies (equal
    smallest three-word hash) count once for each label, by their smallest text, so that a copied document cannot bring in its own words.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_remainder(F.col("doc_id"), folds) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def terms(batches):
        for b in batches:
            out = {"sketch": [], "toxic": [], "text": []}
            for t, y in zip(b["text"], b["toxic"], strict=True):
                w = (t or "").split()
                out["sketch"].append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) - 2**63)
                out["toxic"].append(y)
                out["text"].append(t)
            yield out

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = materialize(map_rows(rows.select("text", "toxic"), terms, "sketch long, toxic int, text string").groupBy("sketch", "toxic").agg(F.min("text").alias("text")), "toxicity")
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        prior = float(toxic > 0)
        return Lexicon(prior=prior, curve=(30.0 if prior else -30.0, 0.0, 0.0), exceptions=exceptions)

    def counted(part) -> DataFrame:
        """(term, pos, neg): sampled documents of each label that hold a term; part gives a text's terms."""
        def work(batches):
            for b in batches:
                count: Counter = Counter()
                for t, y in zip(b["text"], b["toxic"], strict=True):
                    count.update((w, y) for w in part(LETTERS.findall(fold(t or ""))))
                yield {"term": [k[0] for k in count], "toxic": [k[1] for k in count], "n": list(count.values())}

        of = lambda y, name: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)).alias(name)
        return map_rows(once.select("text", "toxic"), work, "term string, toxic int, n long").groupBy("term").agg(of(1, "pos"), of(0, "neg"))

    odds = F.log((F.col("pos") + 0.5) / (toxic + 1.0)) - F.log((F.col("neg") + 0.5) / (clean + 1.0))
    listed = counted(_terms).where((F.col("pos") >= max(3, min_share * toxic)) & (F.col("pos") / float(toxic) >= min_lift * F.col("neg") / float(clean)))
    weights = {r["term"]: r["w"] for r in listed.select("term", odds.alias("w")).collect()}  # terms that min_share of at most sample_rows texts hold
    known = lambda w: any(t in weights for t in _terms([w]))
    beside = lambda words: {f"{a} {c}" for a, c in zip(words, words[1:]) if known(a) or known(c)}
    mild = counted(beside).where((F.col("neg") >= 5) & (F.col("pos") / float(toxic) <= F.col("neg") / float(clean)))
    phrases = frozenset(r["term"] for r in mild.select("term").collect()) if weights else frozenset()
    lexicon = Lexicon(weights, exceptions | phrases, toxic / (toxic + clean))

    def measured(batches):
        automaton = lexicon.automaton()
        for b in batches:
            x = [features(t or "", lexicon, automaton) for t in b["text"]]
            yield {"density": [a for a, _ in x], "hit": [h for _, h in x], "toxic": b["toxic"]}

    sample = map_rows(once.select("text", "toxic"), measured, "density double, hit double, toxic int").toPandas()
    beta = _logistic(sample[["density", "hit"]].to_numpy(), sample["toxic"].to_numpy(float))
    lexicon.curve = tuple(float(v) for v in beta)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", column: str = "toxicity") -> DataFrame:
    """docs, all columns kept, with the score added."""
    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for s in batches:
            yield pd.Series([_probability(features(t or "", lexicon, automaton), lexicon) for t in s], dtype="float64")

    return docs.withColumn(column, rate(F.col(text)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), lexicon, column="score")
    return scored.select("doc_id", (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
