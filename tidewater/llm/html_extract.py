"""Main text of HTML pages: the maximum-scoring subsequence of words and tags.

A page is read once into blocks, each with its words, the tags before it and the
names (tags, and tokens of class, id and role) of the elements around it. All
weights are learned from the labelled pages below: how much likelier a word is
content than not, by itself and by the names of the elements around it, nearest
first, and how much likelier each tag stands outside of content than a word does.
Words of content so score positive, tags and other words negative, and one
linear scan finds the contiguous region with the largest sum. Blocks of negative
score inside the region (an advert between two paragraphs) are left out.

Names never tell against html, body, main and article, nor against an element
that holds the page's first heading and most of its words: such an element is a
wrapper, whatever it is called.

Tags are read by HTML's own rules: a quote opens a value only after '=', a
comment or a raw text element (script, style, ...) without an end goes to the
end of the page. Each character is looked at a bounded number of times.

Defined results: null, empty or tagless-empty html gives the empty text; plain
text without tags is one block; equal sums go to the earlier, longer region;
rows are independent, so repeated rows, null ids and other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame

from .common import map_rows

#: Elements that begin and end a block, those that hold other blocks, those of raw text, and those without any text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul span a button label".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SILENT = frozenset("template head svg math object select canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names never tell against what they hold.
PAGE = frozenset(("html", "body", "main", "article"))

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
NEXT = re.compile(r"[^>=]*+(?:>|=\s*+)")
BARE = re.compile(r"[^\s>]*+")
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")

#: The bounds of a word's score: a block that is no content is left out, so it need not part what is on both sides of it.
LEAST, MOST = -0.3, 3.0
#: The bounds of a tag's score.
LEAST_TAG, MOST_TAG = -0.2, -0.02
#: Log odds that leave nothing to say for the elements further out, and those that are taken for even.
SURE, EVEN = 3.0, 0.7
#: A few pages tell little about a single word: so many words at even odds are added to its counts.
DOUBT = 8.0


class Tags:
    """Where tags and elements end. What was not found once is not looked for again, so all searches together are linear."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def end(self, at: int) -> int:
        """The place after the '>' that ends the tag whose attributes begin at `at`, or -1."""
        while (m := NEXT.match(self.html, at)) is not None:
            at = m.end()
            if self.html[at - 1] == ">" and m[0].find("=") < 0:
                return at
            quote = self.html[at : at + 1]
            k = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            at = k + 1 if k >= 0 else BARE.match(self.html, at).end()
        return -1

    def close(self, tag: str, at: int) -> re.Match | None:
        if tag in self.missing:
            return None
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(self.html, at)
        if m is None:
            self.missing.add(tag)
        return m


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open' or 'close', tag, attributes) in page order; ('skip', '', '') for what holds no text."""
    tags, at, n = Tags(html), 0, len(html)
    while at < n:
        k = tags.find("<", at)
        if k < 0:
            yield "text", html[at:], ""
            return
        if k > at:
            yield "text", html[at:k], ""
        after = html[k + 1 : k + 2]
        if html.startswith("<!--", k):
            end = tags.find("-->", k + 4)
            at = n if end < 0 else end + 3
            yield "skip", "", ""
        elif after in ("!", "?") and after:
            end = tags.find(">", k)
            at = n if end < 0 else end + 1
            yield "skip", "", ""
        else:
            closing = after == "/"
            m = NAME.match(html, k + 1 + closing)
            end = tags.end(m.end()) if m else -1
            if m is None:
                yield "text", "<", ""
                at = k + 1
            elif end < 0:  # the page ends within a tag
                return
            else:
                tag, attributes, at = m[0].lower(), html[m.end() : end - 1], end
                if not closing and tag in RAW | SILENT:
                    gone = tags.close(tag, end)
                    at = gone.end() if gone else n if tag in RAW else end
                    yield "skip", "", ""
                else:
                    yield "close" if closing else "open", tag, attributes


@dataclass
class Element:
    tag: str
    names: frozenset[str]
    #: The number of the element around it; element 0 is the page.
    parent: int
    in_article: bool


@dataclass
class Block:
    text: str
    #: The number of the element around it, and the names of its own p, h1, li, ..., if it has one.
    element: int
    own: frozenset[str]
    #: Names of the tags since the block before.
    tags: tuple[str, ...]


def _names(tag: str, attributes: str) -> frozenset[str]:
    """The tag and the whole tokens of class, id and role, as their words joined by '-'."""
    found = {tag}
    if attributes:
        for m in NAMES.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").split():
                if words := WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()):
                    found.add("." + "-".join(words))
        if HIDDEN.search(attributes):
            found.add("hidden")
    return frozenset(found)


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks in order, character references decoded, white space runs one space, ends trimmed; and its elements, outer before inner.

    Inline elements whose names tell against them part a block.
    """
    out: list[Block] = []
    elements = [Element("", frozenset(), 0, False)]
    stack = [0]
    #: Where each tag's open elements, and those of blocks, are on the stack: the innermost is found at once.
    places: dict[str, list[int]] = defaultdict(list)
    walls: list[int] = []
    pieces: list[str] = []
    own: frozenset[str] = frozenset()
    tags: list[str] = []

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, stack[-1], own, tuple(tags)))
                tags.clear()

    for kind, tag, attributes in tokens(html):
        if kind == "text":
            pieces.append(tag)
            continue
        tags.append(tag)
        if kind == "skip":
            continue
        if tag in BLOCKS:
            flush()
            if kind == "close":
                own = frozenset()
            elif tag not in HOLDERS:
                own = _names(tag, attributes)
        elif tag == "br":
            pieces.append(" ")
        if tag not in HOLDERS or kind == "open" and attributes.endswith("/"):
            continue
        if kind == "open":
            names = _names(tag, attributes)
            if tag in BLOCKS or apart(names):
                flush()
                inside = elements[stack[-1]].in_article
                if inside and tag in ("header", "footer"):
                    names = names - {tag} | {f"{tag}@article"}
                elements.append(Element(tag, names, stack[-1], inside or tag in ("article", "main")))
                stack.append(len(elements) - 1)
                places[tag].append(len(stack) - 1)
                if tag in BLOCKS:
                    walls.append(len(stack) - 1)
        elif places[tag] and (tag in BLOCKS or not walls or walls[-1] < places[tag][-1]):
            flush()
            at = places[tag][-1]
            for k in stack[at:]:
                places[elements[k].tag].pop()
            del stack[at:]
            while walls and walls[-1] >= at:
                walls.pop()
    flush()
    return out, elements


def apart(names: frozenset[str]) -> bool:
    """An inline element whose names tell against it is a block of its own; while weights are learned, none is."""
    return _ready and len(names) > 1 and evidence(names - {"a", "span", "label", "button"}) < 0


#: Labelled pages: what stands in [[..]] marks is main text, all else is not.
LABELLED = [
    # a news site
    """<header class="site-header" id="masthead"><div class="logo">The Daily Reporter</div><div class="tagline">All the news for you</div><nav class="main-navigation" role="navigation"><ul class="menu nav-menu"><li class="menu-item"><a>Home page</a></li><li class="menu-item"><a>World news</a></li><li class="menu-item"><a>Sport</a></li></ul></nav></header>
    <div class="ad ad-banner">Buy one shoe and get one free today</div><main id="main" class="site-main"><article class="post hentry story"><h1 class="entry-title headline">[[A bridge is opened]]</h1><p class="byline meta">By our reporter on Monday</p><div class="entry-content article-body"><p>[[The new bridge was opened to the public on Monday after three years of work.]]</p><p>[[It cost less than planned, the mayor said, and trains will follow in spring.]]</p>
    <div class="advertisement sponsored">Cheap loans from the bank next door</div><p>[[Workers had to stop twice, once for a flood and once for a bird that had built its nest on a crane, and nobody was allowed to go near it until its young could fly.]]</p><p>[[Until then the old road stays open for cars and for people on foot.]]</p></div><div class="share-buttons social">Share this on every network</div></article></main>
    <aside class="sidebar widget-area" id="secondary"><section class="widget widget-recent"><h3 class="widget-title">More stories</h3><ul><li>Bridge falls down</li><li>Mayor opens a school</li></ul></section><section class="widget related-posts"><h3>Related</h3><ul><li>Ten old bridges</li></ul></section></aside>
    <section class="comments comments-area" id="comments"><h2 class="comments-title">Two comments</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I do not like this bridge at all, it is ugly.</p></div></li><li class="comment reply"><div class="comment-body"><p>Neither do I, it is too narrow.</p></div></li></ol><div id="respond" class="comment-respond"><form class="comment-form"><label>Your name</label><textarea></textarea><button>Post comment</button></form></div></section><footer class="site-footer" id="colophon" role="contentinfo"><p>Copyright The Daily Reporter, terms and privacy</p></footer>""",
    # recipes
    """<div class="cookie-consent" role="dialog" id="cookies"><p>We use cookies to make this site better for you.</p><button>Accept all</button></div><div id="header" role="banner"><p>Cooking with us</p></div><div class="breadcrumb">Home Food Soup</div>
    <main><article><header><h1>[[Onion soup]]</h1></header><p>[[Peel the onions and cut them into thin rings, then melt the butter in a heavy pot.]]</p><ul><li>[[four onions]]</li><li>[[a loaf of bread]]</li><li>[[a spoon of butter]]</li></ul><blockquote>[[My aunt always said that more onions help.]]</blockquote><table><tr><td>[[Salt]]</td><td>[[one spoon]]</td></tr></table><figure class="image"><figcaption class="caption">[[The soup in its pot]]</figcaption></figure>
    <footer>Filed under soup by the kitchen team</footer></article><form class="newsletter-signup subscribe"><label>Your address</label><p>Get our letter every week</p><button>Subscribe now</button></form></main><div id="footer" role="contentinfo">Imprint and contact</div>""",
    # a blog
    """<ul class="nav menu" role="navigation"><li>Start</li><li>About</li></ul><form class="search-form" role="search"><label>Search this site</label></form><div class="alert warning notification">This site moves to a new address on Friday</div>
    <div id="content" class="content post-content"><h2 class="post-title title">[[On walking]]</h2><p>[[I walk every day, and every day I see something that I had not seen before.]]</p><h3>[[In rain]]</h3><p>[[Rain changes the colour of everything, and the paths are empty.]]</p><pre class="code">[[left, right, left]]</pre><p class="text">[[At home I write down what I saw.]]</p></div>
    <div class="sharing share">Share this walk</div><div class="author-bio author">Written by a walker who lives in town</div><div class="tags post-tags">walking rain boots</div><div class="pagination pager">Older posts Newer posts</div><div hidden>Not to be seen by anyone</div><div class="disqus" id="disqus_thread">Leave a reply below</div>""",
    # a club
    """<aside>Most read this week and this month</aside><menu><li>File</li><li>Edit</li></menu><section><h1>[[The hill]]</h1><p>[[Nobody lives on the hill now, but walls still stand in the grass.]]</p><figure><figcaption>[[The hill from the south]]</figcaption></figure><dl><dt>[[Height]]</dt><dd>[[three hundred metres]]</dd></dl><p>[[A path leads up from the station and takes an hour.]]</p></section>
    <fieldset><legend>Your vote</legend><p>Did you like this page, yes or no</p></fieldset><dialog>Your session will end soon</dialog><div class="sponsor banner">Boots for every hill</div><div class="toolbar skip-link">Skip to main content</div><footer><p>All rights reserved by the hill club</p></footer>""",
    # manuals
    """<div class="topbar navbar"><span class="brand">Engine docs</span><a class="nav-link">Guide</a><a class="nav-link">API</a></div><div class="container wrapper page" id="wrapper"><div class="sidebar toc"><ul><li>Install</li><li>First steps</li><li>Settings</li></ul></div>
    <div class="main document body" role="main"><h1>[[First steps]]</h1><p>[[Start the engine with one file and look at what it writes.]]</p><div class="section" id="settings"><h2>[[Settings]]</h2><p>[[Each setting has a name and a value, one on a line.]]</p><pre>[[speed = 3]]</pre></div><div class="article-text"><p>[[A wrong value stops the engine at once.]]</p></div></div></div>
    <div class="prev-next pagination">Back to Install, on to Settings</div><div class="feedback-form"><p>Was this page helpful</p><button>Yes</button><button>No</button></div><div class="footer bottom">Built with care by the engine team</div>""",
    # a shop's magazine
    """<div class="promo-bar notice">Free delivery this week only</div><div class="login-form signin"><label>Your mail</label><button>Sign in</button></div><nav class="breadcrumbs">Shop Magazine Tents</nav><div class="row"><div class="column main-column"><article class="blog-post single"><h1 class="page-title">[[How to choose a tent]]</h1><div class="post-body text-content"><p>[[A tent for two weighs about as much as a full bottle of water.]]</p><p>[[Look at the seams before you buy, and set it up once at home.]]</p>
    <div class="ads advert google-ad">Tents from nine pounds, only today</div><p>[[In wind the low ones stand better than the high ones, and a light colour keeps the heat out in the morning, when most people want to sleep a little longer.]]</p><p>[[Dry it well before you put it away for the winter.]]</p></div></article></div><div class="column right-column"><div class="recommended products promo"><p>People also bought a stove</p></div></div></div>
    <div class="popup modal overlay"><p>Ten per cent off for your mail address</p></div><div class="social-links follow">Follow us everywhere</div><div class="site-info legal">Terms, privacy, imprint</div>""",
]
MARK = re.compile(r"\[\[|\]\]")


@dataclass
class Weights:
    """Log odds of content against other text: of any word, of the names around it, of the word itself; and of tags against words."""

    word: float
    tags: dict[str, float]
    names: dict[str, float]
    words: dict[str, float]


def _parts(name: str) -> list[str]:
    return [f".{w}" for w in name[1:].split("-")] if name[0] == "." else []


_ready = False


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Counted over the labelled pages, the class tokens' parts with the tokens."""
    global _ready
    inside: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    words: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    tags: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    total = [0.0, 0.0]
    for page in LABELLED:
        found, elements = blocks(page)
        for b in found:
            other = not b.text.startswith("[[")
            text = MARK.sub("", b.text).lower().split()
            total[other] += len(text)
            for t in b.tags:
                tags[t][other] += 1
            names, k = set(b.own), b.element
            while k:
                names |= elements[k].names
                k = elements[k].parent
            for name in names | {p for n in names for p in _parts(n)}:
                inside[name][other] += len(text)
            for w in text:
                words[w][other] += 1
    _ready = True
    prior, share = math.log(total[0] / total[1]), total[0] / sum(total)
    return Weights(
        word=prior,
        tags={t: max(LEAST_TAG, min(MOST_TAG, math.log((c + 0.5) / (o + 0.5)) - prior)) for t, (c, o) in tags.items()},
        names={k: math.log((c + 0.5) / (o + 0.5)) - prior for k, (c, o) in inside.items()},
        words={w: math.log((c + DOUBT * share) / (o + DOUBT * (1 - share))) - prior for w, (c, o) in words.items()},
    )


@lru_cache(maxsize=20_000)
def evidence(names: frozenset[str]) -> float:
    """The sum of the log odds of an element's names; a token of several words has the mean of theirs, unknown ones being even."""
    known, total = weights().names, 0.0
    for name in names:
        parts = _parts(name)
        total += known[name] if name in known else sum(known.get(p, 0.0) for p in parts) / len(parts) if parts else 0.0
    return total if abs(total) > EVEN else 0.0


def scored(html: str) -> list[tuple[str, float, float]]:
    """(text, score of its words, score of the tags before it) of the page's blocks."""
    w = weights()
    found, elements = blocks(html)
    words = [b.text.split(" ") for b in found]
    held = [0] * len(elements)
    for b, x in zip(found, words, strict=True):
        held[b.element] += len(x)
    for k in range(len(elements) - 1, 0, -1):
        held[elements[k].parent] += held[k]
    # Wrappers: elements around the first heading, or, without a heading, any form or table, that hold most words.
    headed, k = set(), next((b.element for b in found if not b.own.isdisjoint(HEADINGS)), None)
    if k is None:
        headed = {k for k, e in enumerate(elements) if e.tag in ("form", "table")}
    while k:
        headed.add(k)
        k = elements[k].parent
    # What the elements around a word say, the nearest first, each leaving less to those further out.
    around = [0.0] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        value = evidence(e.names)
        if e.tag in PAGE or k in headed and held[k] > held[0] / 2:
            value = max(value, 0.0)
        around[k] = value + max(0.0, 1 - abs(value) / SURE) * around[e.parent]
    out = []
    for b, x in zip(found, words, strict=True):
        each = w.word + evidence(b.own) + around[b.element] + sum(w.words.get(y.lower(), 0.0) for y in x) / len(x)
        out.append((b.text, max(LEAST, min(MOST, each)) * len(x), sum(w.tags.get(t, LEAST_TAG) for t in b.tags)))
    return out


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """[start, end) of the blocks with the largest sum of (words, tags before) scores; the first block's own tags do not count. (0, 0) if no sum is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (words, tags) in enumerate(scores):
        total += tags
        if total <= 0:
            total, start = 0.0, i
        total += words
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = scored(html)
    start, end = best_region([(words, tags) for _, words, tags in found])
    return "\n\n".join(text for text, words, _ in found[start:end] if words > 0)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def work(batches):
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield {"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": list(map(len, text))}

    return map_rows(pages.select("page_id", "url", "html"), work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
