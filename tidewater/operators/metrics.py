"""Exact metrics of scored rows (y_true 0/1, p in [0, 1]), computed where the rows are.

Curves need running totals over descending scores. Scores are first counted by
distinct value and range-partitioned by score; running totals are taken within
partitions, and the totals of those above, one row a partition, are added.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import ranged
from .quantiles import exact_quantiles

#: Fixed diagnostic thresholds of the confusion table.
THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
MAX_POINTS = 2000


def cumulative(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] p, pos, n, tp, fp, total_pos, total_n, at, total): counts at each score, and of all scores from it up; its place by rising score among all."""
    counted = ranged(scored.groupBy(*by, "p").agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")), *by, F.desc("p"))
    above, every = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # one row a part
    parts = counted.groupBy(*by, "__part").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"), F.count(F.lit(1)).alias("__k"))
    before = lambda c, name: F.coalesce(F.sum(c).over(above), F.lit(0)).alias(name)
    parts = parts.select(*by, "__part", before("bp", "cp"), before("bn", "cn"), before("__k", "ck"), F.sum("bp").over(every).alias("total_pos"), F.sum("bn").over(every).alias("total_n"), F.sum("__k").over(every).alias("total_k"))
    own = Window.partitionBy(*by, "__part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"rp": F.sum("pos").over(own), "rn": F.sum("n").over(own), "rk": F.row_number().over(own)}).join(F.broadcast(parts), [*by, "__part"])
    tp, n = F.col("rp") + F.col("cp"), F.col("rn") + F.col("cn")
    return run.select(*by, "p", "pos", "n", tp.alias("tp"), (n - tp).alias("fp"), "total_pos", "total_n", (F.col("total_k") - F.col("rk") - F.col("ck")).alias("at"), F.col("total_k").alias("total"))


def average_precision_by(scored: DataFrame, by: str) -> DataFrame:
    """(by, pr_auc) of each of several few scorings, in one pass."""
    c = cumulative(scored, (by,))
    return c.groupBy(by).agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("total_pos"), F.lit(0))).alias("pr_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Step sum of precision over recall; null without positives."""
    c = cumulative(scored)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("total_pos"), F.lit(0))).alias("pr_auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Trapezoids under the ROC curve; null with one class."""
    c = cumulative(scored)
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg.cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    both = F.max("total_pos") * (F.max("total_n") - F.max("total_pos"))
    return c.agg((area / F.nullif(both, F.lit(0))).alias("roc_auc"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("p") - F.col("y_true"), 2)).alias("brier"))


def pr_curve(scored: DataFrame, points: int = MAX_POINTS) -> DataFrame:
    """(at, threshold, precision, recall) by rising threshold, then the anchor without one: all points, or as many evenly spaced ones as the cap allows, both ends among them."""
    c = cumulative(scored)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("total_pos"), F.lit(0))
    # The anchor is number total. Of the numbers i * total / (points - 1), rounded down, the nearest at or above a place is the only one that may be it.
    chosen = c.where((F.col("total") < points) | (F.expr(f"((at * {points - 1} + total - 1) div total) * total div {points - 1}") == F.col("at")))
    rows = chosen.select("at", F.col("p").alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    anchor = c.agg(F.max("total").alias("at")).select("at", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return rows.unionByName(anchor)


def calibration_curve(scored: DataFrame, bins: int | None = None) -> DataFrame:
    """(bin, mean_score, positive_fraction, n) of quantile bins: a tenth as many as rows, at least 2 and at most 10. Empty bins are absent, and under two rows there is none."""
    n = scored.count()
    bins = bins or min(10, max(2, n // 10))
    edges = exact_quantiles(scored, "p", [i / bins for i in range(1, bins)])
    which = F.size(F.filter(F.array(*[F.lit(e).cast("double") for e in edges]), lambda e: e < F.col("p")))
    return scored.where(F.lit(n > 1)).groupBy(which.alias("bin")).agg(F.avg("p").alias("mean_score"), F.avg(F.col("y_true").cast("double")).alias("positive_fraction"), F.count(F.lit(1)).alias("n"))


def confusion(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision, recall) with p >= threshold as positive; 0.0 on an empty denominator. One pass."""
    y = F.col("y_true") == 1
    parts = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        parts += [F.count_if(hit & y).alias(f"tp{i}"), F.count_if(hit & ~y).alias(f"fp{i}"), F.count_if(~hit & ~y).alias(f"tn{i}"), F.count_if(~hit & y).alias(f"fn{i}")]
    one = scored.agg(*parts)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "tn", "fn")]) for i, t in enumerate(thresholds)])
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return one.select(F.inline(rows)).withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def scalars(scored: DataFrame, name: str) -> DataFrame:
    """(name, n, n_positive, pr_auc, roc_auc, brier): one row from one cumulative pass and one scan."""
    neg = F.col("n") - F.col("pos")
    both = F.max("total_pos") * (F.max("total_n") - F.max("total_pos"))
    curve = cumulative(scored).agg(
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("total_pos"), F.lit(0))).alias("pr_auc"),
        (F.sum(neg.cast("double") * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(both, F.lit(0))).alias("roc_auc"),
    )
    plain = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("n_positive"), F.avg(F.pow(F.col("p") - F.col("y_true"), 2)).alias("brier"))
    return plain.join(curve, how="cross").select(F.lit(name).alias("name"), "n", "n_positive", "pr_auc", "roc_auc", "brier")  # one row each


def evaluate(scored: DataFrame, name: str) -> dict:
    """The full bundle; null scores or labels, and no positives, raise."""
    bad = scored.where(F.col("p").isNull() | F.col("y_true").isNull()).limit(1).count()
    if bad:
        raise ValueError("a score or a label is missing")
    row = scalars(scored, name).first().asDict()
    if not row["n_positive"]:
        raise ValueError("the labels hold no positive")
    parts = {"pr_curve": pr_curve(scored).orderBy("at"), "calibration": calibration_curve(scored).orderBy("bin"), "confusion": confusion(scored)}
    return row | {k: [r.asDict() for r in v.collect()] for k, v in parts.items()}  # bounded by MAX_POINTS


def save_json(result: dict, spark: SparkSession, path: str) -> None:
    """The bundle as one JSON document."""
    spark.createDataFrame([(json.dumps(result),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def compare(results: list[DataFrame]) -> DataFrame:
    """One-row results of scalars(), best PR-AUC first."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.desc("pr_auc"), "name")
