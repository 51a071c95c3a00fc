"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word's letters are a multiset, that is a binary vector over (letter, how many-th).
One edit changes that vector in at most two places. The letters are dealt into
PARTS parts; two vectors that differ in at most two places agree exactly on at least
PARTS - 2 of them, so the letters in each choice of PARTS - 2 parts are a signature and
near words share one (partition and enumerate). Signatures are equi-joined and what
they find is verified by edit distance.

A signature goes together with the half of the word that the edit left alone: if the
shorter of two near words has b code points, then both begin or both end with the
same b // 2 code points. So a word has a key for each signature, half and b (its own
length, and one less, as the longer of the two). That loses no pair, and keeps the
words that share a key few.

Defined results: a null text has no words; a null doc_id counts as an empty text in
the hash; repeated rows count each; an empty table gives an empty result; of near
words with equal n the smallest in code-point order is the form; other columns of
the input are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

#: Parts of the letters. A signature holds PARTS - 2 of them.
PARTS = 3
#: A word that is counted has at least this many code points and occurrences.
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least this many times as often as the word.
TIMES = 2
#: A run of text loses a letter where this divides its hash.
SLIP = 97
#: A task hands its counts on when it holds this many words.
MAX_COUNTED = 300_000

_LETTER = {c: c for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))} | {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Latin-1 bytes: letters stay or are lower-cased, all else is a space.
_TO_WORDS = bytes(_LETTER.get(c, ord(" ")) for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The lower-cased runs [A-Za-z\\u00C0-\\u00FF]+ of a text, as Latin-1: a character outside Latin-1 becomes '?', which ends a run too."""
    return (text or "").encode("latin-1", "replace").translate(_TO_WORDS).split()


def slipped(run: bytes, prefix: int) -> bytes:
    """The run, without one letter where SLIP divides its hash; prefix is the hash of '<doc_id>:'."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[dict[str, list]], max_counted: int) -> Iterator[dict]:
    counts: Counter[bytes] = Counter()

    def out() -> dict:
        return {"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}

    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                word = slipped(run, prefix)
                if len(word) >= MIN_LENGTH:
                    counts[word] += n
            if len(counts) >= max_counted:
                yield out()
                counts.clear()
    yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_counted: int = MAX_COUNTED) -> DataFrame:
    """(word, n) of the words that occur often enough, counted in tasks before the shuffle."""
    partial = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), lambda rows: _count(rows, max_counted), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def signatures(word: Column, parts: int = PARTS) -> list[Column]:
    """The letters, sorted, in each choice of parts - 2 of the parts: a signature equals another if the multisets agree there."""
    letters = F.array_sort(F.split(word, ""))

    def held_by(part: int) -> Column:
        return F.array_join(F.filter(letters, lambda c: F.ascii(c) % parts == part), "")

    held = [held_by(p) for p in range(parts)]
    return [F.concat_ws("|", F.lit("".join(map(str, chosen))), *[held[p] for p in chosen]) for chosen in combinations(range(parts), parts - 2)]


def keyed(words: DataFrame) -> DataFrame:
    """(key, word, longer) for each signature, half and length of the shorter word; longer where the word is the longer one there."""
    length, word = F.length("word"), F.col("word")
    one = words.select("word", length.alias("length"), F.explode(F.array(*signatures(word))).alias("signature"), F.col("n"))
    keys = []
    for longer in (False, True):
        shorter = F.col("length") - int(longer)
        half = F.floor(shorter / 2).cast("int")
        for side, text in (("head", word.substr(F.lit(1), half)), ("tail", word.substr(F.col("length") - half + 1, half))):
            keys.append(F.struct(F.xxhash64(F.lit(side), shorter, text, "signature").alias("key"), F.lit(longer).alias("longer")))
    return one.select("word", F.inline(F.array(*keys)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), both ways, of the words one edit apart."""
    keys = materialize(keyed(words), "spelling_keys")
    a = keys.where(~F.col("longer")).select("key", F.col("word").alias("a"))
    b = keys.select("key", F.col("word").alias("b"), "longer")
    candidates = a.join(b, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    found = candidates.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return found.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their last. Each round doubles the steps; a form has at least TIMES its word's n, so chains are short and have an end."""
    at = materialize(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of docs."""
    words = materialize(word_counts(docs, doc_id, text), "spelling_words")
    near = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("least"), F.col("b").alias("form"))).alias("best"))
    most = -F.col("best.least")
    chosen = most >= TIMES * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, most).alias("form_n"))
    formed = materialize(formed, "spelling_forms")
    return formed.join(roots(formed), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: CRC-32 by its definition: a table from the polynomial, then a step a byte of '<doc_id>:<run>'.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, b::UBIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS crc FROM bits WHERE k = 8),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL),
e AS (SELECT run, n, encode(doc || ':' || run) AS data FROM r),
x AS (SELECT run, n, list_transform(range(octet_length(data)), lambda i: ('0x' || substr(hex(data), 2 * i + 1, 2))::UBIGINT) AS bytes FROM e),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, crc[(xor(c, x) % 256 + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM x, crc_table),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM p),
near AS (SELECT l.word AS word, r.word AS other, r.n AS m FROM cut l JOIN cut r ON l.i = r.i AND l.a = r.a AND l.b = r.b AND l.word <> r.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.a || cut.b UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.a || cut.b),
best AS (SELECT word, count(*) AS n_near, min({'least': -m, 'form': other}) AS best FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.best.least >= 2 * w.n THEN best.best.form END AS form,
  CASE WHEN -best.best.least >= 2 * w.n THEN -best.best.least END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT word, n, n_near, form, form_n, root FROM walk JOIN f USING (word) WHERE walk.next IS NULL
"""
