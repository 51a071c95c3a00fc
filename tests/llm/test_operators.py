"""Each operator on odd tables, empty tables and against a plain version."""

import hashlib
import html
import itertools
import math
import random
import re
import sys
import time
import tracemalloc
import zlib
from collections import Counter

import brute
import public_tokenizers
import pytest
from brute import ordered, pairs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import bpe, common, decontaminate, fingerprints, html_extract, language_id, line_dedup, lm_score, ngram_join, suffix_dedup, toxicity
from tidewater.llm.common import let, shared_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


# 1 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header><h1>Site</h1></header><div class="ad">Buy now, really, buy this now</div><!-- <p>hidden</p> --><article><h1>The &amp; title</h1><p><b>Bold<br>text</b> with&nbsp;spaces<p>Second   one
on two lines</p><aside>Related things to read</aside><div class="cookie-notice"><p>We use cookies</p></div><form><p>Your mail</p><button>Go</button></form><p>&lt;tag&gt; end.</p></article>
<section id="comments"><p>First comment, quite long, longer than the article itself, for it goes on and on and on and on.</p></section><footer>&copy; me</footer></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE) == "The & title\n\nBold text with spaces\n\nSecond one on two lines\n\n<tag> end."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<div></div>", ""), ("plain words", "plain words"), ("<p>a", "a"), ("a < b", "a < b"), ("<nav>x</nav>", ""), ("<p>" + "w " * 50000, ("w " * 50000).strip()), ("<" * 3000, "<" * 3000)])
def test_html_edges(page, text):
    assert html_extract.main_text(page) == text


def test_html_end_tags_find_their_element():
    """However many elements stand between: an inline end tag closes its element through any number of inline ones, and through no block."""
    many = "".join(f"<{t} class='ad'>" for t in ["i", "b"] * 60)
    page = "<article><p>Before words</p><em class='ad'>%s</em><p>After %s more words</p></article>"
    start = time.perf_counter()
    found, elements = html_extract.blocks("<p>" + "<span>" * 20000 + "one two" + "</b></span>" * 20000 + " three</p>")
    assert [b.text for b in found] == ["one two three"] and time.perf_counter() - start < 5
    found, _ = html_extract.blocks(page % (many, "</em>"))
    assert [b.text for b in found] == ["Before words", "After more words"]


@pytest.mark.parametrize("around", ["<body class='has-sidebar'>%s</body>", "<html class='modal-open'><body class='no-sidebar'>%s</body></html>", "<body><div class='article-with-sidebar'>%s</div></body>", "<body><form id='aspnetForm'>%s</form></body>", "<body class='sidebar'>%s</body>"])
def test_html_page_wrappers(around):
    """A name of the whole page takes nothing out; a part of it with such a name still goes, by a whole token or by its score."""
    text = "The mill stood by the river for two hundred years and then fell in one night of rain."
    page = f"<h1>The mill</h1><p>{text}</p><div class='cookie-notice'><p>We use some files here</p></div><div class='sidebar'>Other mills</div><p>{text}</p><div class='comment-list'><p>What a fine old mill that was</p></div>"
    assert html_extract.main_text(around % page) == f"The mill\n\n{text}\n\n{text}"


@pytest.mark.parametrize("page", ['<body><div class="post-content comments-open"><p>%s</p></div></body>', '<article class="has-sidebar"><p>%s</p></article>', '<div class="content widget"><p>%s</p></div>', '<div class="tags-page article"><p>%s</p></div>', '<p class=x"y>%s</p>', "<p title='it's'>%s</p>", '<p title="a > b" data-x=>%s', "<div><p>%s<!-- no end", "<p>%s</p><script>if (a < b) no()", "<p>%s</p><a href='x"])
def test_html_keeps_the_article(page):
    text = "The mill stood by the river for two hundred years and then fell in one night of rain."
    assert html_extract.main_text(page % text) == text


def test_html_region_is_the_best(spark, sf):
    """No other start and end has a larger sum; pages of the table, the labelled ones and random orders of their blocks."""
    r = random.Random(5)
    pages = [p["html"] for p in spark.read.parquet(f"{sf}/pages.parquet").collect()] + html_extract.LABELLED
    for page in pages:
        own = [(w, t) for _, w, t in html_extract.scored(page)][:60]
        for scores in (own, r.sample(own, len(own)), [(w - 2, t - 1) for w, t in own]):
            up = [0.0]
            for w, t in scores:
                up.append(up[-1] + w + t)
            total = lambda a, b: up[b] - up[a] - scores[a][1] if b > a else 0.0
            best = max((total(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
            got = html_extract.best_region(scores)
            assert total(*got) == pytest.approx(max(best, 0.0))


def test_html_articles(spark, sf):
    """The text between the tags of each page's article, read with a plain pattern."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert html_extract.main_text(r["html"]) == "\n\n".join(x for x in parts if x)


@pytest.mark.parametrize("piece", ["<script>", "<svg>", "<a b='", '<p x="', "<!--", "<div ", "<p>a", "<span class=ad>x", "&amp;<"])
def test_html_is_linear(piece):
    took = []
    for n in (40_000, 80_000):
        start = time.process_time()
        html_extract.main_text(piece * n)
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.3


def test_html_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = html_extract.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(out) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in out)
    own = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_extract.extract(own).collect())[:2] == [0, 0]
    assert html_extract.extract(own.limit(0)).count() == 0


# 2 lines


def test_lines_odd(odd, nothing):
    got = line_dedup.line_dedup_digest(odd).drop("keep_runs").collect()
    assert ordered(got) == ordered(brute.keep_lines(pairs(odd)))
    assert line_dedup.line_dedup_digest(nothing).count() == 0
    kept = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(kept.columns) and kept.count() == odd.count()


def test_lines_stream_past_sorted(spark):
    """One range exchange and a real secondary sort, no hash exchange before the first occurrences are known; a hot key is split and counted whole."""
    seen = spark.range(0, 5000, 1, 4).select(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), (F.col("id") % 1700).alias("doc_id"), (F.col("id") % 7).cast("int").alias("pos"))
    seen = seen.unionByName(spark.createDataFrame([(1, 2, None, 0), (3, 3, None, 1), (3, 3, None, 2)], "h1 long, h2 long, doc_id long, pos int"))
    out = line_dedup.key_counts(seen)
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window ") :]
    assert window.index("Sort [") < window.index("rangepartitioning(h1") and "hashpartitioning" not in window and "h1" in window[: window.index("Sort [")]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1701, 1699), (3, 3, 1, None)]


def test_bitmaps_rebuild_the_text(docs):
    rows = line_dedup.line_dedup_digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        lines, at, kept = r["text"].split("\n"), 0, []
        for i, n in enumerate(r["keep_runs"]):
            kept += lines[at : at + n] if i % 2 == 0 else []
            at += n
        assert at == len(lines) and sha("\n".join(kept).encode()) == r["kept_sha256"]


# 3 fingerprints


def test_fingerprints(docs, nothing, odd, spark):
    """All columns equal those of a plain version."""
    text = lambda fp: " ".join(f"{(h << 32 | i) & 2**64 - 1:x}" for h, i in fp)
    for df in (docs, odd.where("doc_id IS NOT NULL AND (text IS NULL OR length(text) < 2000)").dropDuplicates(["doc_id"])):
        out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df, buckets=9).collect()}
        rows = sorted(((d, t or "") for d, t in pairs(df)), reverse=True)
        prints = {d: brute.fingerprint(t.encode()) for d, t in rows}
        assert len(out) == len(rows)
        for i, (d, t) in enumerate(rows):
            (n, u), cut = rows[(i + 1) % len(rows)], len(t) // 3
            edited = (t[: len(t) - cut] + u[:cut]).encode()
            own = brute.fingerprint(edited)
            assert tuple(out[d][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) == (len(t), sha(edited), text(prints[d]), text(own))
            assert out[d]["near_edited"] == pytest.approx(brute.likeness(prints[d], own)) and out[d]["near_next"] == pytest.approx(brute.likeness(prints[d], prints[n]))
    long = [r for r in fingerprints.fingerprint_documents(docs).collect() if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.4 > 0.05 > sum(r["near_next"] for r in long) / len(long)
    assert fingerprints.fingerprint_documents(nothing).count() == 0
    assert fingerprints.fingerprint_documents(odd, buckets=4).count() == odd.count()
    one = fingerprints.fingerprint_documents(docs.limit(1)).first()
    assert one["near_next"] == 1.0


def test_syncmers_are_context_free(spark):
    """A passage has the same anchors in other surroundings, each at most a k-mer's substrings apart, across pieces too."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(9000))
    df = spark.createDataFrame([(passage,), ("something else " * 300 + passage + " and an end",)], "text string")
    a, b = (r["a"] for r in df.select(fingerprints.anchors(F.col("text").cast("binary")).alias("a")).collect())
    own = [(x >> 32, x & 0xFFFFFFFF) for x in a]
    assert {(h, p + 4500) for h, p in own} <= {(x >> 32, x & 0xFFFFFFFF) for x in b}
    assert max(y - x for (_, x), (_, y) in zip(own, own[1:])) <= fingerprints.SPAN


def test_likeness_is_positional(spark):
    """Anchors in another order do not make texts alike; a shifted copy is alike."""
    r = random.Random(4)
    parts = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    texts = ["".join(parts), "x" * 500 + "".join(parts), "".join(f"{p}{'.' * (97 * i % 1009)}" for i, p in enumerate(reversed(parts)))]
    a, b, c = (r["f"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.sketch(F.col("text")).alias("f")).collect())
    near = lambda x, y: spark.createDataFrame([(x, y)], "a array<long>, b array<long>").select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0]
    unpack = lambda f: [(x >> 32, x & 0xFFFFFFFF) for x in f]
    assert near(a, b) > 0.7 and near(a, c) == pytest.approx(brute.likeness(unpack(a), unpack(c))) and near(a, a) == 1.0


# 4 BPE


def test_bpe_is_the_tokenizers_encoding(odd, nothing, docs):
    t = Tokenizer.from_file(BPE)
    for df in (odd, docs):
        expected = []
        for d, text in pairs(df):
            ids = t.encode(text or "", add_special_tokens=False).ids
            expected.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
        assert ordered(bpe.bpe_digest(df, BPE).collect()) == ordered(expected)
    assert bpe.bpe_digest(nothing, BPE).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE)
    assert ordered(back.collect()) == ordered(pairs(docs))


def test_bpe_streams():
    """Pieces of any size give the same tokens, emitted before the word ends, with bounded state."""
    b, r = bpe.Bpe(BPE), random.Random(1)
    t = Tokenizer.from_file(BPE)
    for _ in range(60):
        word = "".join(r.choice(["a", "b", "the", "-", "=", "é", "ing"]) for _ in range(r.randint(1, 3000)))
        data = word.encode()
        pieces = [data[i : i + 37] for i in range(0, len(data), 37)]
        ids = list(b.stream(pieces))
        assert ids == b.encode(word) or any(c in word for c in "-=")
        if not any(c in word for c in "-="):
            assert ids == t.encode(word, add_special_tokens=False).ids
    seen = []
    source = (seen.append(1) or b"ab" * 200 for _ in range(100))
    first = next(b.stream(source))
    assert isinstance(first, int) and len(seen) < 10
    broken = [i for i, x in b.bytes_of.items() if x == b"\xc3"]
    assert "".join(b.decode(broken)) == "\ufffd" and "".join(b.decode(broken + [i for i, x in b.bytes_of.items() if x == b"\xa9"], block=1)) == "é"


@pytest.mark.parametrize("text", ["ab" * 400_000, "é" * 200_000, "the cat sat, and " * 60_000, "<|endoftext|>x " * 30_000, "中文 字" * 60_000], ids=["one word", "one accent", "words", "special", "cjk"])
def test_bpe_long_texts_need_little_memory(text):
    """The library's tokens; beside the text (and its largest word), memory is that of a few blocks."""
    b, t = bpe.Bpe(BPE), Tokenizer.from_file(BPE)
    tracemalloc.start()
    ids, n = hashlib.sha256(), 0
    for some in b.blocks(text):
        assert len(some) <= 8 * bpe.BLOCK
        ids.update("".join(f"{i}," for i in some).encode())
        n += len(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = t.encode(text, add_special_tokens=False).ids
    assert n == len(want) and ids.hexdigest() == sha("".join(f"{i}," for i in want).encode())
    assert peak < 4 * len(text) + 6_000_000


def test_bpe_new_words_share_work():
    """A word not met before costs little where its beginning was met: dictionary look-ups a byte, counted; and bounded memories lose nothing."""
    parts = ["under", "heit", "keit", "ver", "schä", "tion", "lich", "ing"]
    words = [" " + "".join(w) for w in itertools.product(parts, repeat=4)]
    b, t = bpe.Bpe(BPE), Tokenizer.from_file(BPE)
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: event == "c_call" and calls.update([arg.__name__]))
    try:
        got = [b.encode_word(w) for w in words]
    finally:
        sys.setprofile(None)
    assert got == [tuple(t.encode(w, add_special_tokens=False).ids) for w in words]
    assert calls["get"] < 1.5 * sum(len(w.encode()) for w in words)
    r, small = random.Random(5), bpe.Bpe(BPE, cache_words=3)
    words = [" " * r.randint(0, 1) + "".join(r.choice(["a", "b", "the", "é", "ing", "中", "ß", "ab"]) for _ in range(r.randint(1, 21))) for _ in range(3000)]
    words = [w for w in words if small.cut.findall(w) == [w] and len(w) <= bpe.MEMO]
    for w in [*words, *words[:500]]:
        assert list(small.encode_word(w)) == t.encode(w, add_special_tokens=False).ids == list(small.stream(w.encode()[i : i + 5] for i in range(0, len(w.encode()), 5)))
        assert len(small.words) <= 3 and len(small.older) <= 3 and len(small.starts) <= 3


def test_bpe_cuts_latin_texts_alike():
    """Both matchers cut every text of code points below 0x250 in the same words."""
    b, r = bpe.Bpe(BPE), random.Random(6)
    latin = [chr(c) for c in range(0x250)]
    texts = [x + y + z for x in ("", " ", "a", "1", "!") for y in latin for z in ("", " ", "é", "²", "'s", "\xa0")]
    texts += ["".join(r.choice(latin) for _ in range(300)) for _ in range(200)]
    for text in texts:
        assert b.cut_latin.findall(text) == b.cut.findall(text)
    assert b._cut("é\u0250") is b.cut and b._cut("é") is b.cut_latin and b._cut("e") is b.cut_ascii


# 5 join


def near_copies(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_join_hot_groups(spark, seed):
    """A third near copies, many with a common passage, exact copies, short texts."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    random_text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = random_text(30)
    texts = near_copies(r, random_text(80).split(), 60, 4) + [f"{passage} {random_text(r.randint(3, 20))}" for _ in range(40)] + [random_text(r.randint(1, 9)) for _ in range(30)] + [random_text(50)] * 15
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(ngram_join.component_ids(df).collect()) == ordered(brute.components(rows))


def test_join_odd(odd, nothing, docs):
    assert ordered(ngram_join.component_ids(docs).collect()) == ordered(brute.components(pairs(docs)))
    unique = odd.dropDuplicates(["doc_id", "text"]).cache()
    assert ordered(ngram_join.component_ids(unique).collect()) == ordered(brute.components(pairs(unique)))
    assert ngram_join.component_ids(odd).count() == odd.count()
    assert ngram_join.component_ids(nothing).count() == 0


def test_joins_beyond_the_broadcast_bound(odd, docs, benchmark, monkeypatch):
    """What is broadcast while small is shuffled beyond the bound, with the same result."""
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    assert ordered(ngram_join.component_ids(docs).collect()) == ordered(brute.components(pairs(docs)))
    assert {r["doc_id"] for r in ngram_join.keep_one(docs, 5, 80).collect()} == {c for _, _, c in brute.components(pairs(docs), 5, 80)}
    hits = {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()} == {d for d, _ in pairs(docs)} - hits
    assert ngram_join.keep_one(odd).columns == odd.columns and decontaminate.clean(odd, benchmark).columns == odd.columns


def test_long_chains_are_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in ngram_join.components(links).collect()} == {0}


def test_keep_one(odd, docs):
    kept = ngram_join.keep_one(docs, 5, 80)
    expected = {c for _, _, c in brute.components(pairs(docs), 5, 80)}
    assert {r["doc_id"] for r in kept.collect()} == expected and kept.columns == docs.columns
    assert ngram_join.keep_one(odd).columns == odd.columns


# 6 toxicity


def test_folding():
    assert toxicity.fold("1D10T ѕtυріd ＴＲＡＳＨ") == "idiot stupid trash"


def test_toxicity(docs, labels, odd, nothing):
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity_scores(odd, labels).count() == odd.count()
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert max(r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()) < 1e-9


def test_toxicity_is_that_of_a_plain_version(docs, labels, odd):
    """Counting, weights, exceptions and scores by loops over words, without an automaton."""
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    lexicon = toxicity.learn(docs, labels)
    weights, exceptions = brute.lexicon(pairs(docs), known)
    assert lexicon.weights == pytest.approx(weights) and lexicon.exceptions == exceptions and weights
    for df in (docs, odd):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.toxicity_scores(df, labels if df is docs else labels.limit(0)).collect())
        want = sorted((d is None, d or 0, brute.toxicity(t or "", lexicon if df is docs else toxicity.Lexicon(curve=(-30.0, 0.0, 0.0)))) for d, t in pairs(df))
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_exceptions_reach_long_neighbours():
    long = "x" * 500
    lexicon = toxicity.Lexicon({"trash": 5.0}, frozenset({f"{long} trash", f"trash {long}"}), 0.1, (-3.0, 1.0, 6.0))
    hit = lambda t: toxicity.features(t, lexicon, lexicon.automaton())[1]
    assert not hit(f"{long} ... 99 ... trash") and not hit(f"trash, {'-' * 300} {long}") and hit("x" * 499 + " trash")


def test_lexicon_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 5.0}, frozenset({"trash can"}), 0.1, (-3.0, 1.0, 6.0))
    a = lexicon.automaton()
    hit = lambda t: toxicity.features(t, lexicon, a)[1]
    assert toxicity.features("trashing", stem := toxicity.Lexicon({"tras*": 5.0}), stem.automaton())[1]
    assert hit("you are TR4SH!") and not hit("the trash can is full") and not hit("trashy") and not hit("") and hit("trash can, and trash")


def test_toxicity_learns(spark, sf):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9


# 7 repeats


def test_repeats_odd(odd, nothing, docs):
    small = odd.where("text IS NULL OR length(text) < 1000")
    assert ordered(suffix_dedup.repeats_digest(small).collect()) == ordered(brute.repeats(pairs(small)))
    assert suffix_dedup.repeats_digest(odd).count() == odd.count()
    assert suffix_dedup.repeats_digest(nothing).count() == 0
    part = docs.where("length(text) < 3000")
    assert ordered(suffix_dedup.repeats_digest(part).collect()) == ordered(brute.repeats(pairs(part)))


@pytest.mark.parametrize("limit", [1, 10**6])
def test_repeats_random(spark, limit):
    """Periodic texts, short repeats, shared edges, null and equal ids; by broadcast and by join."""
    r = random.Random(limit)
    pieces = ["ab" * 30, "x" * 60, "the quick brown fox jumps over the lazy dog again and again ", "é" * 30, "q", "zz", "the quick brown fox jumps"]
    rows = [(None if r.random() < 0.1 else r.randint(0, 30), None if r.random() < 0.05 else "".join(r.choice([*pieces, str(r.random())]) for _ in range(r.randint(0, 10)))) for _ in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(suffix_dedup.repeats_digest(df, limit=limit).collect()) == ordered(brute.repeats(rows))


# 8 language


def test_language(docs, odd, nothing):
    rows = language_id.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    got = language_id.language_ids(odd)
    assert got.count() == odd.count() and got.where("lang_pred = 'und' AND score = 0").count() >= sum(1 for _, t in pairs(odd) if not t or not any(c.isalpha() for c in t))
    assert language_id.language_ids(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.language_ids(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_is_the_nearest_centroid(docs):
    """Document frequencies, vectors, cosines and rejection by plain loops."""
    import numpy as np

    model = language_id.learn(docs)
    learned = [t for d, t, lang in ((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()) if lang and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    seen = Counter(x for t in learned for x in brute.trigrams(t))
    assert model.idf == pytest.approx([math.log((1 + len(learned)) / (1 + seen[i])) + 1 for i in range(language_id.DIMENSIONS)], rel=1e-5)
    rows = {r["doc_id"]: r for r in language_id.language_ids(docs).collect()}
    rejected = 0
    for d, t in pairs(docs):
        v = {i: math.log1p(n) * model.idf[i] for i, n in brute.trigrams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * c[i] for i, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(near))
        assert rows[d]["lang_pred"] == model.langs[best] and rows[d]["score"] == pytest.approx(near[best], rel=1e-4)
        assert rows[d]["rejected"] == (near[best] < model.radius[best]) or near[best] == pytest.approx(model.radius[best], rel=1e-4)
        rejected += rows[d]["rejected"]
    assert 0 < rejected < len(rows) / 4
    far = list(language_id.predict(["zzqx wvkk jjzq xqqz " * 20], model))
    assert far[0][2]


# 9 LM


LEARNED = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0


@pytest.mark.parametrize("far", [{}, {"max_broadcast": 1}, {"max_bits": 64}])
def test_lm_scores_are_those_of_a_plain_model(docs, odd, nothing, far):
    """Base scores are exact, scores differ by the false positives of the filter alone; by broadcast, and by joins beyond either bound."""
    for df in (docs, odd):
        rows = pairs(df)
        n, expected = brute.unigram_base(rows, LEARNED)
        built = lm_score.fill(lm_score.count(df.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)))
        model = brute.pair_model(rows, LEARNED, false=lm_score.false_mass(*built.agg(F.sum("n_words"), F.avg("false")).first()))
        got = lm_score.lm_scores(df, **far).collect()
        key = lambda d, e: (d is None, d or 0, e[0], e[1], round(e[2], 6))
        assert all(r["train_tokens"] == n for r in got)
        got.sort(key=lambda r: (key(r["doc_id"], (r["n_tokens"], r["n_known"], r["base_score"])), r["score"]))
        want = sorted((key(d, e), model(t)) for (d, t), e in zip(rows, expected))
        assert [key(r["doc_id"], (r["n_tokens"], r["n_known"], r["base_score"])) for r in got] == [k for k, _ in want]
        assert all(r["score"] == pytest.approx(s, rel=1e-3, abs=1e-3) for r, (_, s) in zip(got, want))
    assert lm_score.lm_scores(nothing, **far).count() == 0


def test_lm_probabilities_add_up(docs):
    """After 100 contexts of all frequencies, the probabilities of all words and of an unknown one, as the filter gives them, add up to 1 at most."""
    import numpy as np

    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    built = lm_score.fill(lm_score.count(learned))
    parts, rate = list(lm_score.load(built)), built.agg(F.avg("false")).first()[0]
    f, h, c = [x[0] for x in parts], np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]).astype(float)
    floor, false = c.sum() + 0.1 * (len(c) + 1), lm_score.false_mass(len(c), rate)
    order = np.argsort(c)
    for u in order[np.linspace(0, len(c) - 1, 100).astype(int)]:
        both = np.empty(2 * len(h), np.uint64)
        both[0::2], both[1::2] = h[u], h
        q = lm_score.by_segment(lm_score.pairs(both)[1::2], lambda k, x: f[k].counts(x))
        q, own = np.append(q, 0.0), np.append(c, 0)
        total = (10 ** lm_score._log_p(own, np.full(len(own), c[u]), q, floor, lm_score.PRIOR, false)[1]).sum()
        assert 0.4 < total <= 1 + 1e-9


def test_lm_filter(spark):
    import numpy as np

    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64) * np.uint64(2) | np.uint64(1))
    true = np.array([1 + i % 100 for i in range(len(h))])
    f = [x[0] for x in lm_score.load(lm_score.fill(spark.createDataFrame(list(zip(h.view(np.int64).tolist(), true.tolist())), "h long, n long")))]
    count = lambda h: lm_score.by_segment(h, lambda k, x: f[k].counts(x))
    rough = count(h)
    assert (rough <= true).all() and (rough * 2 > true).all()
    other = np.random.default_rng(2).integers(0, 2**63, 200_000, np.uint64) * np.uint64(2) | np.uint64(1)
    words = np.concatenate([x.words for x in f])
    assert (count(other) > 0).mean() < 3 * lm_score.false_rate(words) + 1e-4 and 64 * len(words) >= lm_score.BITS_PER_ENTRY * len(h)


def test_lm_pairs_count(docs):
    """The pairs tell more than the words alone about texts that were not learned from."""
    held = lm_score.lm_scores(docs).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert held["a"] > held["b"]


def test_lm_pairs_seen_once_count(spark):
    """A word pair of one learning text lifts the score of a text that has it over one with its words in another order."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10][:3]
    rows = [(learned[0], "alpha beta gamma delta"), (learned[1], "beta"), (learned[2], "gamma"), (held, "alpha beta"), (held, "beta alpha")]
    got = [r["score"] for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("held_out").collect()]
    p = lambda w, u, both: u / (u + 101) * both / (u + 1) + 101 / (u + 101) * (w + 0.1) / (9 + 0.1 * 6)
    assert 10 ** got[0] == pytest.approx(p(1, 3, 1) * p(2, 1, 1) * p(3, 2, 1), rel=0.05) and got[0] > got[1]


# 10 benchmark


def test_alignment_is_exact():
    r = random.Random(4)
    for _ in range(60):
        item = bytes(r.choice(b"abcd ") for _ in range(60))
        index = decontaminate.Index([(1, item.decode())], rate=0.1)
        item = index.data[0] if index.data else b""
        if not item:
            continue
        changed = bytearray(item)
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(changed))
            changed[at : at + r.randint(0, 1)] = r.choice([b"", b"x"])
        doc = bytes(r.choice(b"abcd ") for _ in range(r.randint(0, 80))) + bytes(changed) + bytes(r.choice(b"abcd ") for _ in range(40))
        fewest, budget = brute.edits(item, doc), int(index.budget[0])
        got = index.matches(doc)
        assert bool(got) == (fewest <= budget)
        if got:
            assert got[0][3] == fewest and brute.edits(item, doc[got[0][1] : got[0][2]]) == fewest


def test_contamination(docs, benchmark, odd, nothing, spark):
    items = {r["item_id"]: decontaminate.folded(r["text"]) for r in benchmark.collect()}
    hits = decontaminate.contaminated(docs, benchmark).collect()
    exact = {(d, i) for d, t in pairs(docs) for i, x in items.items() if x in decontaminate.folded(t)}
    found = {(r["doc_id"], r["item_id"]) for r in hits}
    assert exact <= found and all(brute.edits(items[i], decontaminate.folded(dict(pairs(docs))[d])) <= len(items[i]) // 10 for d, i in found - exact)
    blocks = decontaminate.contaminated(docs, benchmark, block_bytes=2000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == found
    assert {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()} == {d for d, _ in pairs(docs)} - {d for d, _ in found}
    assert decontaminate.clean(odd, benchmark).count() == odd.count() and decontaminate.clean(odd, benchmark).columns == odd.columns
    assert decontaminate.contaminated(nothing, benchmark).count() == decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    strange = spark.createDataFrame([(1, None), (2, ""), (None, "short"), (3, "x " * 60), (3, "x " * 60)], "item_id long, text string")
    assert decontaminate.contaminated(odd, strange).count() >= 0


def test_near_copies_of_items(spark):
    """All and only the pairs within the edit budget, by edit distances of all pairs; edits of each kind, at the ends and in the middle."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(14)) for i in range(4)]
    rows = []
    for d in range(36):
        near = list(items[d % 4][1])
        for _ in range(r.randint(0, 11)):
            at = r.randrange(len(near))
            near[at : at + r.randint(0, 1)] = r.choice(["", "x", "yz"])
        rows.append((d, f"{text(r.randint(0, 20))} {''.join(near)} {text(r.randint(0, 20))}"))
    folded = {i: decontaminate.folded(t) for i, t in items}
    want = {(d, i) for d, t in rows for i, x in folded.items() if brute.edits(x, decontaminate.folded(t)) <= len(x) // 10}
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and 8 < len(want) < 36


@pytest.mark.parametrize("length", [10, 14, 19, 20, 23, 29, 31, 38, 44, 49, 55])
def test_short_items_with_edits(length):
    """Of every length from one edit on, an item is found if and only if its edits are within the budget."""
    r = random.Random(length)
    found = 0
    for _ in range(40):
        item = bytes(r.choice(b"abcdefgh") for _ in range(length))
        changed = bytearray(item)
        for _ in range(r.randint(0, length // 10 + 1)):
            at = r.randrange(len(changed))
            changed[at : at + r.randint(0, 1)] = r.choice([b"", b"x", b"yz"])
        doc = bytes(r.choice(b"mnop ") for _ in range(r.randint(0, 60))).strip() + bytes(changed) + bytes(r.choice(b"mnop ") for _ in range(30)).strip()
        doc = decontaminate.folded(doc.decode())
        got = decontaminate.Index([(1, item.decode())]).matches(doc)
        assert bool(got) == (brute.edits(item, doc) <= length // 10)
        found += bool(got)
    assert 5 < found


def test_an_index_is_built_once_a_worker():
    first = decontaminate._index_of("a", [(1, "some item of a benchmark")], 0.1)
    assert decontaminate._index_of("a", [], 0.1) is first and decontaminate._index_of("b", [], 0.1) is not first


def test_short_items_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Who wrote  Hamlet?"), (2, "a cat"), (3, "mat"), (4, "?!"), (5, None), (6, "a cat")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "Q: who wrote Hamlet, and when"), (11, "a cation on a mat"), (12, "a cat"), (13, "who wrote it"), (14, None)], "doc_id long, text string")
    found = [tuple(r) for r in decontaminate.contaminated(docs, items).collect()]
    assert sorted(found) == [(10, 1, 2, 18, 0), (11, 3, 14, 17, 0), (12, 2, 0, 5, 0), (12, 6, 0, 5, 0)]
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {13, 14}


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
