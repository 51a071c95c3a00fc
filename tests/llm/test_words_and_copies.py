"""Exact dedup, spelling variants and ranked search on odd and empty tables and against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidewater.llm import exact_dedup, ranked_search, spelling

LATIN = "[A-Za-zÀ-ÿ]+"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def least(doc_id):
    return -math.inf if doc_id is None else doc_id


# 13 exact dedup


def plain_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    return sorted((str(d), str(max(groups[low(t)], key=least)), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows)


def check_copies(df, rows):
    out = df.collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == plain_copies(rows)
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len({r["text_sha256"] for r in out})
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_copies_odd(odd, nothing):
    check_copies(exact_dedup.copies(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).columns == nothing.columns


def test_copies_hot_group_and_one_beginning(spark, monkeypatch):
    """A text that half of the rows hold, and texts that differ in the last character of a long common beginning."""
    monkeypatch.setattr(exact_dedup, "PARTS", 4)
    rows = [(i, "Copy" if i % 2 else "x" * 500 + str(i % 7)) for i in range(400)] + [(3, "cOPY"), (3, "Copy"), (900, "É"), (901, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_copies(exact_dedup.copies(docs), rows)
    dropped = exact_dedup.drop_copies(docs.withColumnRenamed("doc_id", "__copy_id"), doc_id="__copy_id")
    assert dropped.columns == ["__copy_id", "text"]
    assert Counter(low(r["text"]) for r in dropped.collect()) == Counter({low(t) for _, t in rows})


def test_copies_run_no_python(docs):
    plan = exact_dedup.copies(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_equal_hashes_stay_apart(spark, monkeypatch):
    """Neighbours are told apart by their whole texts, whatever their hashes say."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    rows = [(i, "a" * 40 + str(i % 5)) for i in range(30)]
    check_copies(exact_dedup.copies(spark.createDataFrame(rows, "doc_id long, text string")), rows)


# 11 spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def plain_groups(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall(LATIN, t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, str(form[w]), root(w), n[w], out[w], str(n.get(form[w]))) for w in n)


def groups(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in df.collect())


def test_groups_odd(odd, nothing):
    assert groups(spelling.spelling_groups(odd)) == plain_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert spelling.spelling_groups(nothing).count() == 0


def test_groups_by_brute_force(spark):
    """Few letters, so that nearly all words have neighbours, chains and ties of n; counts handed on after every few words."""
    r = random.Random(5)
    words = ["".join(r.choice("aÄÿ") for _ in range(r.choice([4, 5, 5, 6, 6]))) for _ in range(160)]
    rows = [(i, " ".join(r.choice(words[: r.choice([3, 10, 40, 160])]) for _ in range(90)) + " Σ中a") for i in range(60)]
    expected = plain_groups(rows)
    assert sum(e[1] != "None" for e in expected) > 20 and any(e[2] not in (e[0], e[1]) for e in expected if e[1] != "None")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert groups(spelling.spelling_groups(docs)) == expected
    assert {(x["word"], x["n"]) for x in spelling.word_counts(docs, max_counted=7).collect()} == {(e[0], e[3]) for e in expected}


def test_signatures_lose_no_pair(spark):
    """Every pair of words one edit apart shares a key, at both ends and in the middle, of short and long words."""
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        w = "".join(r.choice("abcdefghé") for _ in range(r.randint(5, 14)))
        i, c = r.randrange(len(w)), r.choice("abcxyzé")
        pairs += [(w, w[:i] + w[i + 1 :]), (w, w[:i] + c + w[i:]), (w, w[:i] + c + w[i + 1 :])]
    pairs = [(a, b) for a, b in pairs if a != b and min(len(a), len(b)) >= 5]
    df = spark.createDataFrame([(w, 1) for w in {w for p in pairs for w in p}], "word string, n long")
    found = {(x["a"], x["b"]) for x in spelling.near_pairs(df).collect()}
    assert set(pairs) <= found and all(near(a, b) for a, b in found)


# 12 ranked search


def plain_ranks(rows, items, k=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t))
    held = [(d, Counter(cut(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text))
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


ITEMS = [(1, "one two three four five six"), (2, None), (3, "word word a"), (None, "long line stands ÄÖ 中文"), (5, "nothing-of-this-is-there zzzz"), (6, ""), (7, "a A a tab values"), (7, "a A a tab values")]


def ranks(df):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.mark.parametrize("batch_terms", [10_000, 3])
def test_ranks_odd(spark, odd, nothing, batch_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert ranks(ranked_search.search(ranked_search.build_index(odd), items, batch_terms=batch_terms)) == plain_ranks(rows, ITEMS)
    assert ranked_search.rank_documents(nothing, items).count() == 0
    empty = ranked_search.rank_documents(odd, items.limit(0))
    assert empty.count() == 0 and dict(empty.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_ranks_by_brute_force(spark):
    """Ties, copies of one text in half of the rows, small sketches (many terms on a coordinate) and statistics handed on after every few terms."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "w1 w2 w3 w3 w4" if i % 2 else " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 8)))) for i in range(25)] + [(99, "w1 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = ranked_search.build_index(docs, spread=1, min_width=4, max_counted=5)
    assert ranks(ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain_ranks(rows, items)


def test_bounds_are_bounds():
    """Of every document and query, at every number of occurrences."""
    r = random.Random(0)
    queries = {i: Counter(r.choice([b"a", b"b", b"c", b"d"]) for _ in range(4)) for i in range(10)}
    batch = ranked_search.Batch(queries, {t: r.randint(0, 9000) for t in (b"a", b"b", b"c", b"d")}, 100, 20_000)
    docs = [Counter({t: r.choice([1, 2, 127, 128, 135, 5000, 300_000]) for t in r.sample([b"a", b"b", b"c", b"d", b"e"], 3)}) for _ in range(50)]
    n = [d.total() for d in docs]
    bounds = batch.bounds([ranked_search.sketch(d) for d in docs], n)
    for i, d in enumerate(docs):
        for q in range(10):
            assert bounds[i, q] >= batch.score(q, d, ranked_search.length_factor(n[i], 100, 20_000))


def test_few_documents_are_rescored(spark, docs, sf, monkeypatch):
    """The bounds decide: most documents are never looked at for an item."""
    batch_of = {}
    made = ranked_search.Batch.__init__
    monkeypatch.setattr(ranked_search.Batch, "__init__", lambda self, *a: (made(self, *a), batch_of.update(b=self))[0])
    index = ranked_search.build_index(docs)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    ranked_search.search(index, items).count()
    batch, rows = batch_of["b"], index.docs.collect()
    bounds = batch.bounds([bytes(r["sketch"]) for r in rows], [r["n"] for r in rows])
    scores = [[batch.score(q, Counter(ranked_search.terms(bytes(r["text"]))), ranked_search.length_factor(r["n"], index.n_docs, index.n_terms)) for r in rows] for q in range(20)]
    share = sum((bounds[:, q] >= sorted(scores[q])[-10]).mean() for q in range(20)) / 20
    assert share < 0.5
