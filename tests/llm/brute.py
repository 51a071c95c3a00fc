"""Plain versions of operators that SQL cannot express, over small tables of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

from tidewater.llm import toxicity as toxic

LATE = 2**63 - 2


def words(text):
    return (text or "").encode().lower().split()


def components(rows, n=4, percent=85):
    """[(doc_id, set size, smallest linked doc_id)] by comparing all pairs that share an n-gram."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] from a table of every string's smallest document."""
    number = lambda d: LATE if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, number(d)), number(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < number(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def unigram_base(rows, learn):
    """{row: (n_tokens, n_known, base score)} with counts of the rows that learn() takes."""
    tokens = [words(t) + [b"\n"] for _, t in rows]
    count = Counter(w for (d, _), t in zip(rows, tokens) if learn(d) for w in t)
    n, v = sum(count.values()), len(count)
    return n, [(len(t), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens]


def pair_model(rows, learn, prior=100.0, false=1.0):
    """A text's log10 probability by exact word counts and pair counts rounded down to a power of two."""
    tokens = [words(t) + [b"\n"] for d, t in rows if learn(d)]
    one = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip([b"\n", *t], t))
    floor = sum(one.values()) + 0.1 * (len(one) + 1)

    def score(text):
        t, total = words(text) + [b"\n"], 0.0
        for u, w in zip([b"\n", *t], t):
            base = (one[w] + 0.1) / floor
            q = 1 << two[u, w].bit_length() - 1 if two[u, w] else 0
            share = one[u] / (one[u] + prior + false)
            total += math.log10(share * q / (one[u] + false) + (1 - share) * base)
        return total

    return score


def keep_lines(rows, least=40, docs=5):
    """[(doc_id, n_lines, n_dropped, kept_sha256)]"""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(-1 if d is None else d)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), -1 if d is None else d) == (-1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def edits(item, text):
    """The fewest edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def lexicon(rows, known, held_out=0, min_share=0.02, min_lift=20.0):
    """(weights, exceptions) by counting texts; near copies count once."""
    chosen = {}
    for d, t in rows:
        if d in known and zlib.crc32(str(d).encode()) % 5 != held_out:
            w = (t or "").split()
            key = min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0), known[d]
            chosen[key] = min(chosen.get(key, t or ""), t or "")
    texts = [(t, y) for (_, y), t in chosen.items()]
    n = Counter(y for _, y in texts)
    found = [(re.findall(r"[^\W\d_]+", toxic.fold(t)), y) for t, y in texts]
    forms = lambda w: {w} | {f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k}
    terms = Counter((x, y) for words, y in found for x in {x for w in words for x in forms(w)})
    weights = {}
    for x in {x for x, _ in terms}:
        pos, neg = terms[x, 1], terms[x, 0]
        if pos >= max(3, min_share * n[1]) and pos / n[1] >= min_lift * neg / n[0]:
            weights[x] = math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1))
    two = Counter((f"{a} {b}", y) for words, y in found for a, b in set(zip(words, words[1:])) if forms(a) & weights.keys() or forms(b) & weights.keys())
    return weights, {x for x, _ in two if two[x, 0] >= 5 and two[x, 1] / n[1] <= two[x, 0] / n[0]}


def toxicity(text, lexicon):
    """The score by looking up every word and its beginnings."""
    words = re.findall(r"[^\W\d_]+", toxic.fold(text))
    total = 0.0
    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
        if f"{before} {w}" not in lexicon.exceptions and f"{w} {after}" not in lexicon.exceptions:
            total += max(lexicon.weights.get(w, 0.0), *(lexicon.weights.get(f"{w[:k]}*", 0.0) if len(w) >= k else 0.0 for k in (4, 5, 6)))
    a, b, c = lexicon.curve
    x = a + b * total / math.sqrt(max(1, len(text.split()))) + c * (total > 0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def trigrams(text):
    """Counts of hashed byte trigrams; all but letters and bytes over 127 is one space."""
    b = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {text.lower()} ".encode())
    return Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(b) - 2))


def fingerprint(data, k=20, s=8, size=128):
    """[(32-bit hash, first position)] of the closed syncmers with the smallest hashes."""
    h = lambda b: (xxhash.xxh64_intdigest(b, 42) + 2**63) % 2**64 - 2**63
    inner, first = [h(data[i : i + s]) for i in range(len(data) - s + 1)], {}
    for i in range(len(data) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            first.setdefault(h(data[i : i + k]) >> 32, i)
    return sorted(first.items())[:size] or ([(h(data) >> 32, 0)] if data else [])


def likeness(a, b, size=128, band=32):
    """The share of the union's smallest hashes that both have on a common diagonal."""
    if not a and not b:
        return 1.0
    a, b = dict(a), dict(b)
    union = sorted(a.keys() | b.keys())[:size]
    offsets = [a[h] - b[h] for h in union if h in a and h in b]
    return sum(x == 0 or sum(abs(x - y) <= band for y in offsets) > 1 for x in offsets) / len(union)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))
