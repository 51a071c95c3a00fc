"""Corpus cleaning: five stages over documents, each an operator of the llm subpackage.

Each stage takes all that its predecessor kept; every stage but the last returns
the columns of documents. Stages are written as Parquet in the shared folder and
read again, so a lost executor never costs more than a stage.

For every stage: documents may hold any other columns, whatever their names, and
get them back as they were; an empty table gives an empty one; repeated rows fare
alike, but in the n-gram join. Each says what becomes of null and empty texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tidewater.llm.common import free_name, materialize, table

#: Not expressible in SQL (learned lexicon, edit distances, BPE): tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5. A null or empty text holds no term and stays; ids are not read, null ones neither."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__toxicity")
    return toxicity.score(docs, lexicon, column=score).where(F.col(score) < 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in at least five of them, but in the last; n_chars follows.

    A null text stays null, an empty one empty. A null doc_id is one more document, before all others; rows with one doc_id are one document.
    """
    own = free_name(docs, line_dedup.OWN)
    out = line_dedup.dedup_lines(docs, own=own)
    changed = F.col(f"{own}dropped") > 0
    new = {"text": F.when(changed, F.col(f"{own}kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(f"{own}kept")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.withColumns(new).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    The smallest doc_id stays, a null one only where there is no other; of repeated rows one. Null texts, and texts without a word, are like nothing
    and all stay.
    """
    return ngram_join.keep_one(docs, n=5, percent=80).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; so does everything if the benchmark is empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text is an empty one, of no tokens."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("decontamination", drop_benchmark), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
