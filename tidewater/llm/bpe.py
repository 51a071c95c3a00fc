"""Byte-level BPE encoding and decoding as a streaming transducer.

For every byte position the last token of the encoding of the text so far is
unique: it is the one vocabulary string ending there whose boundary with the
last token before it no merge would cross. So a left-to-right scan needs one
token a position. A token is stable once the chains of all positions that a
later token can still reach (those within the longest token) run through its
end; it is emitted then and its bytes are forgotten. `lookahead`, computed from
the merge list, is how far a merge's outcome can depend on what follows; the
scan tests for stable tokens once that many bytes are pending, so memory stays
constant for a word of any length. A word of up to MEMO characters is there
whole, so of the same table only the positions that its end depends on are
filled, from the end back; the tokens of such words and of their beginnings,
which many words share, are remembered, a bounded number a task. A text is cut
into words, encoded, hashed and decoded block by block. Decoding feeds token
bytes to an incremental UTF-8 state machine.

Defined results: null or empty text has no tokens and decodes to the empty
text; the special token's own string in a text becomes the special token, as
the tokenizer file says; rows are independent, so repeated rows, null ids and
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Fixed values of the byte-level format: how a text is cut into words, and which byte values print as themselves.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: The same for text of code points below 0x250 alone, whose letters and numbers are few ranges: re is faster than regex.
LATIN, LETTERS, NUMBERS = "\0-\u024f", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = WORDS.replace(r"\p{L}", f"[{LETTERS}]", 1).replace(r"\p{N}", f"[{NUMBERS}]", 1).replace(r"\p{L}\p{N}", LETTERS + NUMBERS)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Characters of text that are cut into words at once, words at once in a longer text, and the longest word whose tokens are remembered.
BLOCK = 65_536
WORDS_AT_ONCE = 4_096
MEMO = 64


def _characters() -> dict[str, int]:
    """The format's character for each byte: itself if printable, else the next code point from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _trie(tokens: Iterable[tuple[bytes, int]]) -> dict:
    """Of each byte the next bytes, and the token that ends with it; shorter tokens come first."""
    root: dict = {}
    for (*path, end), i in tokens:
        node = root
        for x in path:
            node = node.setdefault(x, ({}, None))[0]
        node[end] = (node[end][0] if end in node else {}, i)
    return root


class Bpe:
    """One tokenizer file, with the tables of the transducer. cache_words bounds the memory of encoded words."""

    def __init__(self, path: str, cache_words: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _characters()
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Of each token that a merge makes: the merge's rank and its two parts. Of each pair: the rank of its merge.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank[pair] = r
            self.made.setdefault(vocab[a + b], (r, *pair))
        #: Tries of the tokens' bytes: from the first one on, and from the last one back.
        plain = sorted(vocab.values(), key=lambda i: len(self.bytes_of[i]))
        self.trie = _trie((self.bytes_of[i], i) for i in plain)
        self.ends = _trie((self.bytes_of[i][::-1], i) for i in plain)
        self.longest = max(len(self.bytes_of[i]) for i in vocab.values())
        self.lookahead = self._lookahead()
        #: Of each token: the tokens tried after it, and whether they can stand there. Forgotten when known_pairs grows too large.
        self.fits: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        #: Encoded words, the newer and the older half; each holds at most cache_words.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: Tokens of the beginnings of short words, which other words share.
        self.starts: dict[bytes, tuple[int, ...]] = {}
        self.cache_words = cache_words
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cut = regex.compile(WORDS)
        self.cut_latin, self.beyond_latin = re.compile(LATIN_WORDS), re.compile(f"[^{LATIN}]")
        self.cut_ascii = re.compile(ASCII_WORDS, re.ASCII)

    def _lookahead(self) -> int:
        """How many bytes after a boundary can still decide whether a merge crosses it.

        In merge order: a token's outcome waits for that of its right part, and for every earlier merge that would take that part instead.
        """
        need: dict[int, int] = dict.fromkeys(self.bytes_of, 0)
        taken: dict[int, int] = dict.fromkeys(self.bytes_of, 0)  # by the merges so far whose left part it is
        made_by = {r: t for t, (r, _, _) in self.made.items()}
        for (a, b), r in self.rank.items():
            if (made := made_by.get(r)) is not None:
                need[made] = max(need[b], taken[b], need[a] - len(self.bytes_of[b]))
            taken[a] = max(taken[a], len(self.bytes_of[b]) + need[b])
        return max(taken.values(), default=0)

    def boundary(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: undoing their merges from the last one on, no pair at the boundary would have merged earlier."""
        known = self.fits.setdefault(a, {}).get(b)
        if known is None:
            x, y, before, fits = a, b, len(self.rank) + 1, True
            while True:
                r = self.rank.get((x, y))
                if r is not None and r < before:
                    fits = False
                    break
                rx, ry = self.made.get(x, (-1,))[0], self.made.get(y, (-1,))[0]
                if rx < 0 and ry < 0:
                    break
                if rx > ry:  # the later merge is undone first; a pair merges from the left if ranks tie
                    before, x = rx, self.made[x][2]
                else:
                    before, y = ry + 1, self.made[y][1]
            if self.known_pairs >= 250_000:
                for after in self.fits.values():  # a scan may hold one of them
                    after.clear()
                self.known_pairs = 0
            known = self.fits[a][b] = fits
            self.known_pairs += 1
        return known

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one word that comes in pieces, each as soon as it is stable."""
        held, last, done = bytearray(), [-1], 0  # bytes since the last stable boundary; the last token at each position since then; starts that were tried
        for piece in pieces:
            for start in range(0, len(piece), 1024):
                part = piece[start : start + 1024]
                held += part
                last += [None] * len(part)
                ready = max(done, len(held) - self.longest + 1)
                self._scan(held, last, done, ready)
                done = ready
                if done > self.lookahead + self.longest and (at := self._meeting(last, done)):
                    yield from self._chain(last, at)
                    del held[:at], last[:at]
                    done -= at
        self._scan(held, last, done, len(held), True)
        yield from self._chain(last, len(held))

    def _scan(self, held: bytes, last: list, start: int, end: int, ends: bool = False) -> None:
        """Tries the tokens at the starts; the first that fits what stands before, the longest, is the last one of its end.

        If the word ends with held, the scan does so with the token that reaches the word's end: its chain has only positions that were tried.
        """
        trie, fits, boundary, longest = self.trie, self.fits, self.boundary, self.longest
        for i in range(start, end):
            before = last[i]
            if before is None:
                continue  # no encoding ends here
            node, j = trie, i
            after = fits.get(before)
            if after is None:
                after = fits[before] = {}
            for x in held[i : i + longest]:
                step = node.get(x)
                if step is None:
                    break
                j += 1
                node, t = step
                if t is not None and last[j] is None:
                    if before == -1:
                        last[j] = t
                    else:
                        fit = after.get(t)
                        if fit or fit is None and boundary(before, t):
                            last[j] = t
            if ends and last[-1] is not None:
                break

    def _whole(self, back: bytes) -> tuple[int, ...]:
        """Tokens of a short word that is there whole, its bytes from the last to the first; none if no encoding ends there.

        The last token at its end is, as in _scan, the longest of those that end there and fit what stands before; so only the positions that it depends on are asked for. What was found for the beginnings of words is remembered, at most cache_words of them.
        """
        node, n, found = self.ends, 0, []
        for x in back:
            step = node.get(x)
            if step is None:
                break
            n += 1
            node, t = step
            if t is not None:
                found.append((n, t))
        for n, t in reversed(found):
            if n == len(back):
                return (t,)
            start = back[n:]
            head = self.starts.get(start)
            if head is None:
                head = self._whole(start)
                if len(self.starts) >= self.cache_words:
                    self.starts.clear()
                self.starts[start] = head
            if head:
                after = self.fits.get(head[-1])
                fit = after.get(t) if after is not None else None
                if fit or fit is None and self.boundary(head[-1], t):
                    return (*head, t)
        return ()

    def _meeting(self, last: list, end: int) -> int:
        """The last position that the chains of all positions within reach of `end` have in common."""
        heap = [-p for p in range(max(0, end - self.longest), end + 1) if last[p] is not None]
        heapq.heapify(heap)
        while heap[0] != heap[-1] or len(set(heap)) > 1:
            p = -heapq.heappop(heap)
            while heap and heap[0] == -p:
                heapq.heappop(heap)
            if p == 0:
                return 0
            heapq.heappush(heap, -(p - len(self.bytes_of[last[p]])))
        return -heap[0]

    def _chain(self, last: list, at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The transducer's output for a word of at most MEMO characters, remembered."""
        ids = self.words.get(word)
        if ids is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            ids = self._whole(word.encode()[::-1])
            if not ids:
                raise KeyError(word)  # the file has no token for one of its bytes
        if len(self.words) >= self.cache_words:
            self.words, self.older = {}, self.words
        self.words[word] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The text's token ids, a bounded number at a time: beside the text itself, memory does not grow with it or with its words."""
        at = 0
        for m in self.split.finditer(text) if self.split is not None else ():
            yield from self._plain(text, at, m.start())
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _cut(self, text: str) -> re.Pattern | regex.Pattern:
        if text.isascii():
            return self.cut_ascii
        return self.cut if self.beyond_latin.search(text) else self.cut_latin

    def _plain(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        if start == end:
            return
        if end - start <= BLOCK:
            piece = text[start:end]
            yield from self._block(self._cut(piece).findall(piece))
        else:
            words = (m[0] for m in self._cut(text).finditer(text, start, end))
            while some := list(islice(words, WORDS_AT_ONCE)):
                yield from self._block(some)

    def _block(self, words: list[str]) -> Iterator[list[int]]:
        """One look into the remembered words for each; those not there are encoded, and a long one cuts the block."""
        found, start = list(map(self.words.get, words)), 0
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            if len(w) <= MEMO:
                found[i] = self.encode_word(w)
            else:
                yield list(chain.from_iterable(found[start:i]))
                ids = self.stream(w[k : k + BLOCK].encode() for k in range(0, len(w), BLOCK))
                while some := list(islice(ids, WORDS_AT_ONCE)):
                    yield some
                start = i + 1
        yield list(chain.from_iterable(found[start:] if start else found))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text, piece by piece; bytes that are not UTF-8 become U+FFFD."""
        machine, ids = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while some := list(islice(ids, block)):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, some)))
        yield machine.decode(b"", True)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of each row."""
    def work(batches):
        bpe = Bpe(path)  # goes with its caches when the task ends: workers live on, and other operators need the memory
        for b in batches:
            yield {key: b[key], "ids": [bpe.encode(t or "") for t in b[text]]}

    return map_rows(docs.select(key, text), work, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of each row of ids."""
    def work(batches):
        bpe = Bpe(path)
        for b in batches:
            yield {key: b[key], "text": ["".join(bpe.decode(x or [])) for x in b["ids"]]}

    return map_rows(encoded.select(key, "ids"), work, f"`{key}` {dict(encoded.dtypes)[key]}, text string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; encoding and decoding share one pass."""
    def work(batches):
        bpe = Bpe(path)
        names = {i: str(i) for i in bpe.bytes_of}
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in b["text"]:
                n, ids_hash, decoded, machine = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for ids in bpe.blocks(t or ""):
                    if ids:
                        ids_hash.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                        decoded.update(machine.decode(b"".join(map(bpe.bytes_of.__getitem__, ids))).encode())
                        n += len(ids)
                decoded.update(machine.decode(b"", True).encode())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(ids_hash.hexdigest())
                out["decoded_sha256"].append(decoded.hexdigest())
            yield out

    return map_rows(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
