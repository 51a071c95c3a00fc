"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is its UTF-8 bytes. A k-mer of K bytes is an anchor if the smallest of
its inner S-byte substrings, by hash, is the first or the last of them: that
depends on the k-mer alone, so equal passages have equal anchors wherever they
stand. A fingerprint is the bottom sketch of the anchors: the `size` smallest
32-bit anchor hashes, each with the position of its first occurrence. An anchor
is written as one long: the hash above, the position below.

Matching is positional. Of the anchors that two fingerprints share, those count
that stand on a common diagonal: the offset between the two positions is within
BAND of that of another shared anchor, or is 0. Likeness is their share of the
sketch of the union.

As anchors are context-free, the edited text's fingerprint is put together from
the sketch of the text's first part and the anchors of the rest, and no text is
looked at twice. Texts are looked at in pieces of PIECE bytes.

Defined results: null text counts as empty and has the empty fingerprint; a text
shorter than a k-mer, or without an anchor, has one anchor, its whole text at 0;
likeness is 1 for two empty fingerprints and 0 for one; repeated rows follow each
other in the order of their texts' hashes; a null doc_id comes after all others;
the next document of a table's only row is itself; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

K, S = 20, 8
SPAN = K - S + 1  # inner substrings of a k-mer
PIECE = 4_096
BAND = 32
HIGH = -(1 << 32)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _pack(h: Column, pos: Column) -> Column:
    return h.bitwiseAND(F.lit(HIGH)).bitwiseOR(pos.cast("long"))


def _hash(a: Column) -> Column:
    return F.shiftright(a, 32)


def _pos(a: Column) -> Column:
    return a.bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(data: Column) -> Column:
    """Packed anchors of binary data, in text order."""
    def piece(start: Column) -> Column:
        def of(p: Column) -> Column:
            inner = F.transform(F.sequence(F.lit(0), F.octet_length(p) - S), lambda i: F.xxhash64(F.substring(p, i + 1, F.lit(S))))

            def pick(s: Column) -> Column:
                # Each chain of comparisons ends at the first smaller substring, after two or three on average.
                first = lambda i: reduce(Column.__and__, [F.get(s, i) <= F.get(s, i + j) for j in range(1, SPAN)])
                last = lambda i: reduce(Column.__and__, [F.get(s, i + SPAN - 1) <= F.get(s, i + j) for j in range(SPAN - 2, -1, -1)])
                edge = F.filter(F.sequence(F.lit(0), F.size(s) - SPAN), lambda i: first(i) | last(i))
                return F.transform(edge, lambda i: _pack(F.xxhash64(F.substring(p, i + 1, F.lit(K))), start + i))

            return let(inner, pick)

        return let(F.substring(data, start + 1, F.lit(PIECE + K - 1)), of)

    n = F.octet_length(data)
    return F.when(n >= K, F.flatten(F.transform(F.sequence(F.lit(0), n - K, F.lit(PIECE)), piece))).otherwise(_none())


def bottom(found: Column, size: int) -> Column:
    """The size smallest hashes among packed anchors, each with its first position."""
    new = lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, F.greatest(i - 1, F.lit(0))))))
    return F.slice(let(F.sort_array(found), new), 1, size)


def _whole(data: Column, found: Column) -> Column:
    """found, or the one anchor of a text that has none."""
    return let(found, lambda f: F.when((F.size(f) == 0) & (F.octet_length(data) > 0), F.array(_pack(F.xxhash64(data), F.lit(0)))).otherwise(f))


def sketch(text: Column, size: int = 128) -> Column:
    """The fingerprint as a sorted array of at most size packed anchors."""
    return let(F.coalesce(text, F.lit("")).cast("binary"), lambda data: _whole(data, bottom(anchors(data), size)))


def likeness(a: Column, b: Column, size: int = 128) -> Column:
    """The share of the union's sketch whose anchors both fingerprints have on a common diagonal."""
    hashes = lambda x: F.transform(x, _hash)

    def of(u: Column) -> Column:
        def on_diagonals(same: Column) -> Column:
            kept = lambda x: F.filter(x, lambda y: F.array_contains(same, _hash(y)))

            def near(o: Column) -> Column:
                close = lambda x, i: (x == 0) | ((i > 0) & (x - F.get(o, F.greatest(i - 1, F.lit(0))) <= BAND)) | F.coalesce(F.get(o, i + 1) - x <= BAND, F.lit(False))
                return F.size(F.filter(o, close)) / F.size(u).cast("double")

            offsets = F.zip_with(kept(a), kept(b), lambda x, y: _pos(x) - _pos(y))
            return F.when(F.size(same) == 0, F.lit(0.0)).otherwise(let(F.sort_array(offsets), near))

        return let(F.array_intersect(u, F.array_intersect(hashes(a), hashes(b))), on_diagonals)

    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(let(F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, size), of))


def as_text(fingerprint: Column) -> Column:
    """The packed anchors in hexadecimal: the last eight digits are the position, those before them the hash."""
    return F.lower(F.array_join(F.transform(fingerprint, F.hex), " "))


def with_next(docs: DataFrame, key: str, version: str, carried: list[str], buckets: int) -> DataFrame:
    """docs with next_<c> for each carried column c: that of the next row by descending key; after the last row comes the first.

    Rows are dealt into buckets of neighbouring keys. The first row of each bucket is also sent, as a ghost, to the bucket before it, so
    no window spans more than a bucket. Only the bucket edges and the largest key of each bucket, at most `buckets` of each, reach the driver.
    """
    spark, k = docs.sparkSession, F.col(key)
    side = max(1, round(buckets**0.5))
    n = side * side
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    if cuts:  # two levels: about 2 * sqrt(n) comparisons a row
        outer = cuts[::side]
        rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in cuts[i + 1 : i + side]]).cast("array<bigint>") for i in range(0, len(cuts), side)])
        high = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in outer]), lambda e: e < k))
        low = F.size(F.filter(F.get(rows, high - 1), lambda e: e < k))
        bucket = F.when(k.isNull() | (high == 0), F.lit(0)).otherwise((high - 1) * side + 1 + low)
    else:
        bucket = F.lit(0)
    heads = docs.groupBy(bucket.alias("bucket")).agg(F.max(key).alias("head")).orderBy(F.desc("bucket")).collect()
    ghosts = [(h["head"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]  # heads[-1] for the first: the wrap
    ghost = F.broadcast(spark.createDataFrame(ghosts, "_head long, _to int"))
    dealt = docs.join(ghost, k.eqNullSafe(F.col("_head")), "left").withColumn(
        "_seat", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(bucket.alias("b"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("ghost")))))
    )
    w = Window.partitionBy("_seat.b").orderBy("_seat.ghost", F.col(key).desc_nulls_last(), version)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return led.where(~F.col("_seat.ghost")).drop("_head", "_to", "_seat")


def fingerprint_documents(docs: DataFrame, size: int = 128, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the next document.
    """
    if buckets is None:
        buckets = min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"v": F.xxhash64("text"), "n": F.length("text"), "cut": F.floor(F.length("text") / 3).cast("int")})
    first = F.substring("text", F.lit(1), F.col("n") - F.col("cut")).cast("binary")
    own = own.withColumn("end", F.octet_length(first))

    def two(data: Column) -> Column:
        """The sketches of the text and of its first part."""
        inside = lambda a: F.filter(a, lambda x: _pos(x) + K <= F.col("end"))
        return let(anchors(data), lambda a: F.array(_whole(data, bottom(a, size)), bottom(inside(a), size)))

    # An array, not a struct: Spark would compute each field of a struct by itself, before the shuffle.
    own = own.withColumn("sketches", let(F.col("text").cast("binary"), two))
    led = with_next(own, "doc_id", "v", ["text", "sketches"], buckets)
    pieces = led.withColumns({"begin": F.greatest(F.col("end") - (K - 1), F.lit(0)), "first": first, "rest": F.substring("next_text", F.lit(1), F.col("cut")).cast("binary")}).drop("text", "next_text", "v")

    def edited(data: Column) -> Column:
        """The edited text's sketch: that of its first part, and the anchors from its last K - 1 bytes on."""
        late = F.transform(anchors(F.substring(data, F.col("begin") + 1, F.octet_length(data))), lambda x: x + F.col("begin"))
        return _whole(data, bottom(F.concat(F.get("sketches", F.lit(1)), late), size))

    pieces = pieces.withColumn("data", F.concat("first", "rest"))
    both = pieces.withColumns({"fp": F.get("sketches", F.lit(0)), "next_fp": F.get("next_sketches", F.lit(0)), "efp": let(F.col("data"), edited)})
    return both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("data", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp"), size).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), size).alias("near_next"))
