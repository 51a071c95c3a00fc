"""Append-only audit log of enforcement actions, and the review queue read from it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import names_in, publish, published

#: Fixed schema of the log.
CONTRIBUTION = T.ArrayType(T.StructType([
    T.StructField("feature_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("shap_contribution", T.DoubleType()),
]))
AUDIT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_timestamp", T.TimestampType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("click_timestamp", T.TimestampNTZType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("policy_version", T.StringType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("calibrated_score", T.DoubleType()),
    T.StructField("threshold_block", T.DoubleType()),
    T.StructField("threshold_review", T.DoubleType()),
    T.StructField("action", T.StringType()),
    T.StructField("top_features", CONTRIBUTION),
    T.StructField("reviewer_disposition", T.StringType()),
    T.StructField("reviewer_timestamp", T.TimestampType()),
    T.StructField("notes", T.StringType()),
])
ACTIONS = ("AUTO_BLOCK", "HUMAN_REVIEW", "QA_SAMPLE", "ALLOW")
OPTIONAL = ("reviewer_disposition", "reviewer_timestamp", "notes")


def rows(routed: DataFrame, model_version: str, policy_version: str, block: float, review: float, keep_allowed: bool = False) -> DataFrame:
    """Audit rows of (case_id, click_time, raw_score, calibrated_score, action[, top_features])."""
    kept = routed if keep_allowed else routed.where(F.col("action") != "ALLOW")
    top = F.col("top_features").cast(CONTRIBUTION) if "top_features" in routed.columns else F.array().cast(CONTRIBUTION)
    return kept.select(
        F.uuid().alias("event_id"), F.current_timestamp().alias("event_timestamp"), F.col("case_id").cast("string").alias("case_id"), F.col("click_time").alias("click_timestamp"),
        F.lit(model_version).alias("model_version"), F.lit(policy_version).alias("policy_version"), "raw_score", "calibrated_score",
        F.lit(block).cast("double").alias("threshold_block"), F.lit(review).cast("double").alias("threshold_review"), "action", top.alias("top_features"),
        *[F.lit(None).cast(AUDIT[c].dataType).alias(c) for c in OPTIONAL],
    )


def violation() -> Column:
    """Why a row breaks the schema, or null."""
    out = F.lit(None).cast("string")
    for c in ("raw_score", "calibrated_score", "threshold_block", "threshold_review"):
        out = F.coalesce(out, F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), f"{c} is not in [0, 1]"))
    out = F.coalesce(out, F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action"))
    for f in AUDIT:
        if f.name not in OPTIONAL:
            out = F.coalesce(out, F.when(F.col(f.name).isNull(), f"{f.name} is missing"))
    return out


def append(entries: DataFrame, path: str, batch: str | None = None) -> int:
    """Append checked rows as one batch; a row that breaks the schema raises, and nothing of its batch is in the log. Returns the number of rows.

    The rows are evaluated and written once, into the batch's own folder, and what is written there is counted and checked. A batch is in the log when its
    commit record is, which comes last. A batch of a name that is committed is not written again, one that failed before is replaced: so a
    stream that gives its batch number may repeat a batch. An empty batch is committed and writes no rows.
    """
    spark, batch = entries.sparkSession, batch or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    if (done := published(spark, f"{path}/commits/{batch}")) is not None:
        return int(done)
    folder = f"{path}/batches/batch={batch}"
    entries.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT]).write.mode("overwrite").partitionBy("action").parquet(folder)
    found = spark.read.schema(AUDIT).parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.count_if(violation().isNotNull()).alias("bad"), F.max(violation()).alias("why")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} audit rows are invalid: {found['why']}")
    publish(spark, f"{path}/commits/{batch}", str(found["n"]))
    return found["n"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the committed batches."""
    done = [f"{path}/batches/batch={b}" for b in names_in(spark, f"{path}/commits") if not b.endswith(".tmp") and not b.startswith(".")]
    parts = [spark.read.schema(AUDIT).option("basePath", f"{path}/batches").parquet(*done[i : i + 1000]).select(*AUDIT.names) for i in range(0, len(done), 1000)]
    out = parts[0] if parts else spark.createDataFrame([], AUDIT)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def review_queue(log: DataFrame, limit: int = 500) -> DataFrame:
    """Cases for review, the least likely legitimate first, with their reasons spread out."""
    order = ("calibrated_score", "case_id")
    top = log.where(F.col("action") == "HUMAN_REVIEW").orderBy(*order).limit(limit)
    return top.select("case_id", "click_timestamp", "raw_score", "calibrated_score", "model_version", "policy_version", F.to_json("top_features").alias("top_features"))
