"""Exact dedup by content sort, with DataFrame functions only.

Texts are range-partitioned and sorted by their content, in the order (first HEAD
code points, 64-bit hash, whole text), so that equal texts are neighbours wherever
they come from. The splitters are sampled by Spark from the first two and the
part number alone, so that what the driver samples is short for texts of any
length. A row whose whole text equals its neighbour's belongs to the neighbour's
run; a run is one row from there on. A text's copies are dealt into parts by their
doc_id, so that a text that a third of all rows hold is many ranges; what the
parts' runs say is put together, a row a part. Whole texts move once.

Defined results: a null text is an empty text; equal is what is equal after A-Z
are lower-cased; a null doc_id is smaller than any other; of repeated rows (equal
text and doc_id) one is kept; an empty table gives an empty result; other columns
of the input, whatever their names, are not read by the digest and are returned as
they are by drop_copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, materialize

#: Code points that the splitters see.
HEAD = 32
#: Parts that the copies of a text are dealt into, at least; as many as two a shuffle partition if that is more.
PARTS = 64


def normalised(text: Column) -> Column:
    """text (null: empty) with A-Z lower-cased. lower() does that, many times faster, where all characters are ASCII."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(lower_ascii(plain))


def content_sorted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, first) of each row: first where the row before it in the content order, in its part, has another text.

    digest is the SHA-256 of the normalised text.
    """
    parts = max(PARTS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("body"))
    keyed = rows.select("doc_id", "body", F.substring("body", 1, HEAD).alias("head"), F.xxhash64("body").alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    stream = Window.partitionBy("head", "h", "part").orderBy("body", F.desc_nulls_last("doc_id"))
    before = F.lag("body").over(stream)
    return keyed.repartitionByRange("head", "h", "part").select("doc_id", "part", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), (before.isNull() | (before != F.col("body"))).alias("first"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs; of a text's rows the one with the largest doc_id is kept."""
    rows = materialize(content_sorted(docs, doc_id, text), "content_sorted")
    runs = rows.groupBy("digest", "part").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("digest")  # at most a row for each part
    found = runs.select("digest", "part", F.max("top").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))
    # Equal doc_ids are in one part, so the first row there with the text's largest doc_id is the one that stays.
    return rows.join(found, ["digest", "part"]).select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns kept, without the rows whose text is equal to that of a row with a larger doc_id; of repeated rows all stay."""
    own = free_name(docs, "__copy_")
    lost = copies(docs, doc_id, text).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(f"{own}id"), F.col("text_sha256").alias(f"{own}digest")).distinct()
    digest = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    return docs.join(lost, F.col(doc_id).eqNullSafe(F.col(f"{own}id")) & (digest == F.col(f"{own}digest")), "left_anti")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""
