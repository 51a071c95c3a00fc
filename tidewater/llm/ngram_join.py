"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word n-grams (64-bit hashes). Equal sets are one class
with one representative. Tokens are put in one global order, common ones last,
and the first |x| - ceil(t * |x|) + SHARE of a set's are kept: two sets with
Jaccard t or more share SHARE of these.

Similar documents are first partitioned into groups: each set is compared with
the most common holder of each of its kept tokens, and sets that link form a group.
The matrix holds each group's union of kept tokens. A set's kept tokens then
probe the other groups: a group with fewer than SHARE of them cannot hold a
partner; nor can one whose tokens known to be shared are too few. Only the others
are opened, and their members with SHARE kept tokens in common are verified on
whole sets. A group of G near copies so costs G
comparisons, not G * G, and no link between groups is lost.

Common tokens (the lowest quarter of hashes, and all hashes of the sets that
have too few uncommon ones) are broadcast in tables of at most MAX_COMMON rows,
whatever the input: the order only affects speed, never the result.

Defined results: null, empty and white-space texts have the empty set, link
with nothing and are their own component; a text with fewer words than n has
its whole word sequence as its one n-gram; equal sets always link; each input
row gets its row, repeated ones too; component_id is the smallest non-null
doc_id reachable; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, map_rows, materialize, restrict

SHARE = 3
MAX_COMMON = 1_000_000
COMMON_SETS = 12
CROWD = 30
#: Edges of a file, about.
FILE_ROWS = 200_000
LOW = np.uint64(1 << 62)  # a quarter of all hashes
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * _A
        out ^= out >> np.uint64(31)
    out *= _B
    return np.unique(out ^ (out >> np.uint64(29)))


def prefix_size(n: int, t: float, share: int) -> int:
    return min(n, n - math.ceil(t * n - 1e-9) + share)


def _sets(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(rid, doc, size, d1, d2, low): low are the tokens below LOW and at least as many of the smallest as are kept."""
    def work(batches):
        hashes = _Hashes()
        for b in batches:
            out = {k: [] for k in ("rid", "doc", "size", "d1", "d2", "low")}
            for r, d, text in zip(b["rid"], b["doc"], b["text"], strict=True):
                s = shingles(text, n, hashes)
                k = max(int(np.searchsorted(s, LOW)), prefix_size(len(s), t, SHARE))
                digest = xxhash.xxh128_intdigest(s.tobytes())
                for name, x in zip(out, (r, d, len(s), (digest >> 64) - 2**63, (digest & 2**64 - 1) - 2**63, s[:k].view(np.int64)), strict=True):
                    out[name].append(x)
            yield out

    return map_rows(docs.select("rid", "doc", "text"), work, "rid long, doc long, size long, d1 long, d2 long, low array<long>")


def _common(tokens: DataFrame):
    """Broadcast (tokens, numbers of sets) of the tokens that most sets hold: at most MAX_COMMON."""
    counted = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= COMMON_SETS), "common")
    if counted.count() > MAX_COMMON:
        steps = [COMMON_SETS << i for i in range(50)]  # the least threshold that few enough tokens reach
        reach = counted.agg(*[F.sum(F.when(F.col("sets") >= s, 1).otherwise(0)).alias(f"s{s}") for s in steps]).first()
        counted = counted.where(F.col("sets") >= next((s for s in steps if reach[f"s{s}"] <= MAX_COMMON), 2**62))
    rows = counted.orderBy("token").toArrow()
    return tokens.sparkSession.sparkContext.broadcast((np.asarray(rows["token"], np.int64), np.asarray(rows["sets"], np.int64)))


def _known(x: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of sets of each token, 0 where it is not common."""
    token, count = table
    if not len(token):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(token, x), len(token) - 1)
    return np.where(token[at] == x, count[at], 0)


def _kept(docs: DataFrame, low: DataFrame, n: int, t: float) -> DataFrame:
    """(rid, size, own, tokens): the kept tokens of each set, in one global order; own: its share of uncommon tokens, in thousandths.

    First come uncommon low tokens by hash; most sets have enough of them. All other tokens follow, by the number of sets among those
    that need them, then by hash. A set of the first kind keeps the same tokens whatever the order of the rest.
    """
    is_low = (F.col("token") >= 0) & (F.col("token") < int(LOW))
    common = _common(low.select(F.explode("low").alias("token")).where(is_low))

    def first(batches):
        for b in batches:
            out = {k: [] for k in ("rid", "size", "tokens")}
            for r, size, own in zip(b["rid"], b["size"], b["low"], strict=True):
                x = np.array(own, np.int64)
                x = x[(x >= 0) & (x < np.int64(LOW))]
                x = x[_known(x, common.value) == 0]
                need = prefix_size(size, t, SHARE)
                for name, y in zip(out, (r, size, x[:need] if len(x) >= need else None), strict=True):
                    out[name].append(y)
            yield out

    tried = materialize(map_rows(low, first, "rid long, size long, tokens array<long>"), "kept")
    rest = restrict(docs.select("rid", "text"), tried.where(F.col("tokens").isNull()).select("rid").distinct(), "left_semi")

    def others(batches):
        hashes = _Hashes()
        for b in batches:
            out = {k: [] for k in ("rid", "size", "uncommon", "other")}
            for r, text in zip(b["rid"], b["text"], strict=True):
                x = shingles(text, n, hashes).view(np.int64)
                free = (x >= 0) & (x < np.int64(LOW)) & (_known(x, common.value) == 0)
                for name, y in zip(out, (r, len(x), x[free], x[~free]), strict=True):
                    out[name].append(y)
            yield out

    wide = materialize(map_rows(rest, others, "rid long, size long, uncommon array<long>, other array<long>"), "others")
    again = _common(wide.select(F.explode("other").alias("token")))

    def second(batches):
        for b in batches:
            out = {k: [] for k in ("rid", "size", "own", "tokens")}
            for r, size, free, other in zip(b["rid"], b["size"], b["uncommon"], b["other"], strict=True):
                x = np.array(other, np.int64)
                known = _known(x, again.value)
                order = np.lexsort((x.view(np.uint64), known))
                kept = np.concatenate([np.array(free, np.int64), x[order]])[: prefix_size(size, t, SHARE)]
                for name, y in zip(out, (r, size, 1000 - 1000 * int((known > 0).sum()) // size, kept), strict=True):
                    out[name].append(y)
            yield out

    enough = tried.where(F.col("tokens").isNotNull()).withColumn("own", F.lit(1000))
    return enough.unionByName(map_rows(wide, second, "rid long, size long, own int, tokens array<long>"))


def _verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()

    def work(batches):
        hashes = _Hashes()
        for b in batches:
            yield {"rid": b["rid"], "tokens": [shingles(t, n, hashes).view(np.int64) for t in b["text"]]}

    sets = materialize(map_rows(restrict(docs.select("rid", "text"), needed, "left_semi"), work, "rid long, tokens array<long>"), "whole")
    both = pairs.join(sets.withColumnsRenamed({"rid": "a", "tokens": "x"}), "a").join(sets.withColumnsRenamed({"rid": "b", "tokens": "y"}), "b")
    k = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(k * 100 >= (F.size("x") + F.size("y") - k) * percent).select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component), the smallest node of each component, by alternating large and small stars until nothing changes.

    A round's tables are written in as many files as the edges before it fill, at FILE_ROWS each.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        files = 1 + 2 * now[0] // FILE_ROWS
        all_ = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = all_.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = all_.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large.coalesce(files), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct().coalesce(files), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _possible(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with at most this overlap can link."""
    return overlap * 100 >= (a + b - overlap) * percent


def _rest(size: Column, percent: int) -> Column:
    """The tokens of a set that are not kept. Of two sets' common tokens, at most the larger rest are not among their common kept ones."""
    return F.greatest(F.floor((size * percent + 99) / 100) - SHARE, F.lit(0))


def _shared_tokens(kept: DataFrame) -> DataFrame:
    """(token, rid, size, own, first): kept tokens of at least two sets; first is the holder with the most common tokens."""
    rows = kept.select("rid", "size", "own", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.min(F.struct("own", "rid"))["rid"].alias("first"), F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high").select("token", "first")
    held, few_held = bounded(held)
    if few_held:
        few = kept.sparkSession.sparkContext.broadcast(np.sort(np.asarray(held.select("token").toArrow()["token"])))

        def matching(batches):
            for b in batches:
                out = {k: [] for k in ("rid", "size", "own", "token")}
                for r, size, own, tokens in zip(b["rid"], b["size"], b["own"], b["tokens"], strict=True):
                    x = np.array(tokens, np.int64)
                    x = x[few.value[np.minimum(np.searchsorted(few.value, x), len(few.value) - 1)] == x].tolist() if len(few.value) else []
                    for name, y in zip(out, ([r] * len(x), [size] * len(x), [own] * len(x), x), strict=True):
                        out[name] += y
                yield out

        rows = map_rows(kept, matching, "rid long, size long, own int, token long")
    return materialize(rows.join(held, "token"), "shared")


def _crowded(docs: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """(rid, reach) of the sets with a kept token that over CROWD groups hold: how many of all their tokens another of these sets holds.

    No two of these sets have more in common than the smaller reach.
    """
    crowd = placed.groupBy("token").agg(F.count_distinct("grp").alias("groups")).where(F.col("groups") > CROWD).select("token")
    members = materialize(placed.join(crowd, "token", "left_semi").select("rid").distinct(), "crowd")

    def work(batches):
        hashes = _Hashes()
        for b in batches:
            for r, text in zip(b["rid"], b["text"], strict=True):
                x = shingles(text, n, hashes).view(np.int64)
                yield {"rid": [r] * len(x), "token": x}

    tokens = materialize(map_rows(restrict(docs.select("rid", "text"), members, "left_semi").dropDuplicates(["rid"]), work, "rid long, token long"), "crowd")
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    return materialize(members.join(tokens.join(several, "token", "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("reach")), "rid", "left").select("rid", F.coalesce("reach", F.lit(0)).alias("reach")), "reach")


def _links(docs: DataFrame, kept: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between representatives; all links between groups, and enough within each group to connect it."""
    shared = _shared_tokens(kept)

    # Groups: sets that link with the first holder of some kept tokens.
    star = shared.where("rid <> first").groupBy(F.col("first").alias("a"), F.col("rid").alias("b")).agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    near = _verify(docs, star, n, percent)
    groups = components(near)
    groups = groups.join(groups.groupBy("component").agg(F.count_distinct("node").alias("members")), "component").withColumnRenamed("node", "rid")
    placed = shared.join(groups, "rid", "left").select("token", "rid", "size", F.coalesce("component", "rid").alias("grp"), F.coalesce("members", F.lit(1)).alias("members"))
    placed = materialize(placed.distinct(), "placed")
    placed = materialize(placed.join(_crowded(docs, placed, n), "rid", "left"), "placed")

    # The matrix: each group's union of kept tokens, its sizes and reach. A query may reach what both sides reach, if both are crowded.
    # Of two groups, the members of the smaller one ask the larger one: a link between them is found from either side.
    matrix = placed.groupBy("token", "grp").agg(F.max("members").alias("all"), F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.coalesce("reach", "size")).alias("far"), F.count_if(F.col("reach").isNull()).alias("free"))
    query = placed.withColumnRenamed("grp", "own")
    asks = (F.col("members") < F.col("all")) | ((F.col("members") == F.col("all")) & (F.col("own") < F.col("grp")))
    size, low, high = F.col("size"), F.col("low"), F.col("high")
    most = F.when(F.col("reach").isNotNull() & (F.col("free") == 0), F.least("reach", "far")).otherwise(F.least(size, high))
    partner = F.greatest(low, F.least(most, high))  # the size that suits best
    bound = query.join(matrix, "token").where(asks & _possible(F.least(most, partner, size), size, partner, percent))
    counted = bound.groupBy("rid", "grp").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    upper = F.col("k") + F.greatest(_rest(size, percent), _rest(high, percent))
    opened = counted.where((F.col("k") >= SHARE) & _possible(upper, size, low, percent)).select("rid", "grp")
    opened = materialize(opened, "opened")
    # An opened group's members are met pair by pair, not token by token: a row a pair, with the kept tokens of both.
    who = materialize(placed.groupBy("rid", "grp").agg(F.max("size").alias("size"), F.max("reach").alias("reach")), "who")
    inside = who.select(F.col("rid").alias("m"), F.col("size").alias("m_size"), F.col("reach").alias("m_reach"), "grp")
    overlap = F.least("size", "m_size", F.when(F.col("reach").isNotNull() & F.col("m_reach").isNotNull(), F.least("reach", "m_reach")))
    met = opened.join(who.drop("grp"), "rid").join(inside, "grp").where(_possible(overlap, size, F.col("m_size"), percent)).select("rid", "m", "size", "m_size")
    tokens = kept.select("rid", "tokens")
    met = met.join(tokens, "rid").join(tokens.withColumnsRenamed({"rid": "m", "tokens": "m_tokens"}), "m").withColumn("k", F.size(F.array_intersect("tokens", "m_tokens")))
    pairs = met.where((F.col("k") >= SHARE) & _possible(F.col("k") + _rest(F.greatest("size", "m_size"), percent), size, F.col("m_size"), percent)).select(F.least("rid", "m").alias("a"), F.greatest("rid", "m").alias("b"))
    return near.unionByName(_verify(docs, pairs, n, percent))


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, rid, n_shingles, class_id (of equal sets), component (of linked sets), component_id (its smallest doc_id)."""
    t = percent / 100
    doc = F.col("doc_id").cast("long")
    keyed = docs.select(doc.alias("doc"), "text").withColumn("rid", F.xxhash64("doc", F.coalesce("text", F.lit(""))))
    sets = materialize(_sets(keyed, n, t), "sets")
    reps = materialize(sets.where("size > 0").groupBy("d1", "d2").agg(F.min("rid").alias("rep"), F.min("size").alias("size")), "reps")
    # Only a set that can have a partner of another size, or of its own with a token changed, takes part.
    n_ = F.col("size")
    able = (F.floor(n_ * 100 / percent) > n_) | (F.ceil(n_ * percent / 100) < n_)
    own = reps.where(able).select(F.col("rep").alias("rid"))
    low = restrict(sets.select("rid", "size", "low"), own, "left_semi")
    kept = materialize(_kept(keyed, low, n, t), "prefixes")
    found = components(_links(keyed, kept, n, percent))
    classes = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "rep", F.coalesce("component", "rep").alias("component"))
    placed = sets.select("rid", "doc", "size", "d1", "d2").join(classes, ["d1", "d2"], "left")
    placed = placed.select("rid", "doc", "size", F.coalesce("rep", "rid").alias("class_id"), F.when(F.col("size") > 0, F.coalesce("component", "rid")).alias("component"))
    placed = materialize(placed, "placed")
    least = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc").alias("least"))
    return placed.join(least, "component", "left").select(F.col("doc").alias("doc_id"), "rid", F.col("size").alias("n_shingles"), "class_id", F.coalesce("component", "rid").alias("component"), F.coalesce("least", "doc").alias("component_id"))


def component_ids(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns kept, with one document of each component: its smallest (doc_id, rid). Texts without words stay."""
    key = free_name(docs, "__join_rid")
    found = jaccard_join(docs.select("doc_id", "text"), n, percent).where("n_shingles > 0").select("component", "rid", F.col("doc_id").alias("doc"))
    found = materialize(found, "components")
    keepers = found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc", F.lit(2**63 - 1)), "rid"))["rid"].alias("keeper"))
    lost = found.join(keepers, "component").where("rid <> keeper").select(F.col("rid").alias(key)).distinct()
    kept = restrict(docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))), lost, "left_anti")
    repeated = materialize(found.groupBy("rid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("rid").alias(key)), "repeated")
    if repeated.isEmpty():
        return kept.drop(key)
    return restrict(kept, repeated, "left_anti").unionByName(restrict(kept, repeated, "left_semi").dropDuplicates([key])).drop(key)
