"""Line dedup with DataFrame functions only.

Lines are keyed by a 128-bit hash. The keys are range-partitioned, with a
secondary sort by document and position, so that each key's lines stream past
in order: the first of each document is counted, and the first of all belongs to
the document that keeps the key. A key's documents are dealt into SLICES parts by
a hash, so that a key that a third of all documents hold is many ranges; what its
slices found, a row each, is added up. Text itself is never shuffled for that.
The result is one compressed keep bitmap per document: run lengths, alternately
kept and dropped.

Defined results: a null or empty text is one empty line; a null doc_id is one
more document, smaller than any other; a repeated row is the same document and
gets the same bitmap; an empty table gives an empty result; other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, free_name, let, lower_ascii, materialize


#: Prefix of the columns that dedup_lines adds to those of its input.
OWN = "__lines_"
#: Parts that the documents of a key are dealt into.
SLICES = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, pos, h1, h2) of each line whose key has at least min_chars code points."""
    keys = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("pos"), lower_ascii(F.btrim(x, F.lit(WHITE))).alias("key")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(F.lit(1), x["key"]).alias("h1"), F.xxhash64(F.lit(2), x["key"]).alias("h2")))
    return docs.select(F.col(doc_id).alias("doc_id"), _version(F.col(text)).alias("version"), F.inline(hashed))


def key_counts(seen: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, keeper) of each key: how many documents hold it, and the largest doc_id among them (null if no other is)."""
    dealt = seen.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"), "doc_id", "pos").repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc_id"), "pos")
    own = F.struct("doc_id")
    firsts = dealt.select("h1", "h2", "doc_id", F.row_number().over(stream).alias("at"), (~F.lag(own).over(stream).eqNullSafe(own)).alias("new")).where("new")
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.when(F.col("at") == 1, F.col("doc_id"))).alias("keeper"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, runs): the dropped runs (start, length) of each document that loses a line.

    A key held by at least min_docs documents keeps its lines in the largest doc_id only.
    """
    seen = materialize(line_keys(docs, min_chars, doc_id, text), "lines")
    # Both sides of the join are tables, so that a hot key's partition can be split.
    common = materialize(key_counts(seen).where(F.col("n_docs") >= min_docs), "line_keys")
    lost = seen.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    at = lost.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter(F.col("at"), lambda x, i: (i == 0) | (F.get(F.col("at"), i - 1) < x - 1))
    ends = F.filter(F.col("at"), lambda x, i: F.coalesce(F.get(F.col("at"), i + 1) > x + 1, F.lit(True)))
    return at.select("doc_id", "version", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, in order."""
    def part(run: Column, i: Column) -> Column:
        before = F.get(runs, i - 1)
        begin = F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["length"])
        return F.slice(lines, begin + 1, run["start"] - begin)

    last = F.element_at(runs, -1)
    end = last["start"] + last["length"]
    return F.concat(F.flatten(F.transform(runs, part)), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text", own: str | None = None) -> DataFrame:
    """docs, all columns kept, with total, dropped, kept and runs, each prefixed by own, added; own is OWN, followed by as many '_' as docs' column names need."""
    own = free_name(docs, OWN) if own is None else own
    maps = keep_bitmaps(docs, min_chars, min_docs, doc_id, text).select(F.col("doc_id").alias(f"{own}id"), F.col("version").alias(f"{own}version"), F.col("runs").alias(f"{own}runs"))
    joined = docs.join(maps, F.col(doc_id).eqNullSafe(F.col(f"{own}id")) & (_version(F.col(text)) == F.col(f"{own}version")), "left")
    plain = F.coalesce(F.col(text), F.lit(""))
    kept = F.when(F.col(f"{own}runs").isNull(), plain).otherwise(let(_lines(F.col(text)), lambda lines: F.array_join(_kept(lines, F.col(f"{own}runs")), "\n")))
    dropped = F.coalesce(F.aggregate(f"{own}runs", F.lit(0), lambda a, r: a + r["length"]), F.lit(0))
    n_lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1
    return joined.withColumns({f"{own}total": n_lines.cast("long"), f"{own}dropped": dropped.cast("long"), f"{own}kept": kept}).drop(f"{own}id", f"{own}version")


def line_dedup_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256, keep_runs (run lengths: kept, dropped, kept, ...)."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    def lengths(run: Column, i: Column) -> Column:
        before = F.get(F.col(f"{OWN}runs"), i - 1)
        return F.array(run["start"] - F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["length"]), run["length"])

    runs = F.coalesce(F.flatten(F.transform(f"{OWN}runs", lengths)), F.array().cast("array<int>"))
    rest = F.col(f"{OWN}total").cast("int") - F.aggregate(runs, F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", F.col(f"{OWN}total").alias("n_lines"), F.col(f"{OWN}dropped").alias("n_dropped"), F.sha2(F.col(f"{OWN}kept").cast("binary"), 256).alias("kept_sha256"), F.concat(runs, F.array(rest)).alias("keep_runs"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
