"""End-to-end plans: the feature table of a split, and the first pipeline and enforcement runs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.features import NUMERIC, all_features
from ..operators.sampling import stratified_sample
from ..operators.triage import fraud_score, quantile_thresholds, route, two_way
from ..sources import audit
from ..sources.clicks import EVENT_SPLITS, Split, split_predicate
from ..sources.shared import publish, published
from ..sources.store import FeatureStore
from .models import F1F2, fit_logreg, linear_contributions, predict, tree_contributions


#: Name of what the passes compute; another name makes kept passes of older code count as missing.
PASSES_VERSION = "1"


class KeptPasses:
    """Passes of all_features kept as tables, so that a build that was broken off goes on after its last whole pass.

    A pass belongs to the input that it was made from (its content, whatever its order). Its manifest, which is written last, names its
    folder; a folder without one is what a broken run has left and is not read. All splits of one input share the passes.
    """

    def __init__(self, spark: SparkSession, root: str, made_from: str):
        self.spark, self.root, self.made = spark, f"{root.rstrip('/')}/{hashlib.sha256(f'{PASSES_VERSION} {made_from}'.encode()).hexdigest()[:24]}", 0

    def keep(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        manifest = f"{self.root}/{name}.json"
        if (found := published(self.spark, manifest)) is None:
            folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
            table = run()
            table.write.parquet(folder)
            publish(self.spark, manifest, json.dumps({"folder": folder, "schema": table.schema.jsonValue()}))
            self.made += 1
            found = published(self.spark, manifest)  # of two runs at a time, the first to publish
        entry = json.loads(found)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["folder"])


def feature_table(clicks: DataFrame, split: str | None = None, sample_fraction: float | None = None, splits: tuple[Split, ...] = EVENT_SPLITS, kept: KeptPasses | None = None) -> DataFrame:
    """All features. Windows see all earlier rows; the split and the sample are taken after them."""
    out = all_features(clicks, keep=kept.keep if kept else None)
    if split is not None:
        out = out.where(split_predicate(split, splits))
    if sample_fraction is not None:
        out = stratified_sample(out, sample_fraction)
    return out


def input_version(clicks: DataFrame) -> str:
    """Rows and content hash of the input, whatever its order."""
    one = clicks.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*clicks.columns)).alias("h"), F.sum(F.xxhash64(*clicks.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{one['n']}-{one['h'] or 0}-{one['s'] or 0}"


def materialize_features(clicks: DataFrame, store: FeatureStore, version: str, split: str, source: str, sample_fraction: float | None = None, made_from: str | None = None) -> int:
    """Write a split's features to the store; returns its rows. A table made from the same input is reused, one made from another raises.

    made_from: input_version(clicks), where the caller has it; else it is taken from the clicks, a pass over them.

    The passes are kept in the store, for the other splits and for a run after a broken one.
    """
    made_from = input_version(clicks) if made_from is None else made_from
    origin = f"{source}#{made_from}#{sample_fraction}"
    row = lambda: store.metadata().where((F.col("version") == version) & (F.col("split") == split)).limit(1).collect()
    if not (done := row()):
        kept = KeptPasses(clicks.sparkSession, f"{store.root}/passes", made_from)
        store.save(feature_table(clicks, split, sample_fraction, kept=kept), version, split, origin)
        done = row()
    if done[0]["source"] != origin:
        raise ValueError(f"{split} of {version} was made from other input: {done[0]['source']}, not {origin}")
    return done[0]["n_rows"]


def pipeline(clicks: DataFrame, log_path: str, splits: tuple[Split, ...] = EVENT_SPLITS) -> int:
    """Fit the linear model on train, explain and log every val row with the placeholder routing; returns the rows logged."""
    table = all_features(clicks)
    train, val = (table.where(split_predicate(s, splits)) for s in ("train", "val"))
    scored = linear_contributions(fit_logreg(train, F1F2), val, F1F2)
    routed = scored.select(F.col("row_id").cast("string").alias("case_id"), "click_time", F.col("p").alias("raw_score"), F.col("p").alias("calibrated_score"), two_way("p").alias("action"), "top_features")
    return audit.append(audit.rows(routed, "logreg-v1", "two-way-v1", 0.5, 0.5, keep_allowed=True), log_path)


def enforce(spark: SparkSession, model: PipelineModel, table: DataFrame, log_path: str, calibrated=None, rate: float = 0.005, seed: int = 42, limit: int | None = None) -> dict[str, int]:
    """Score a split, route at demonstration quantiles, explain and log what is not allowed; returns the action mix."""
    rows = table.orderBy("row_id").limit(limit) if limit else table
    scored = predict(model, rows, NUMERIC).withColumns({"raw_score": F.col("p"), "calibrated_score": calibrated(F.col("p")) if calibrated else F.col("p"), "fraud_score": fraud_score("p"), "case_id": F.col("row_id").cast("string")}).cache()
    cut = quantile_thresholds(scored).first()
    routed = route(scored, cut["t_block"], cut["t_review"], rate, seed)
    mix = {r["action"]: r["n"] for r in routed.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    acted = routed.where("action <> 'ALLOW'").select(*table.columns, "case_id", "raw_score", "calibrated_score", "action")
    audit.append(audit.rows(tree_contributions(model, acted, NUMERIC), "gbt-v1", "quantile-v1", float(cut["t_block"]), float(cut["t_review"])), log_path)
    scored.unpersist()
    return mix
