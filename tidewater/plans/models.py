"""Models on Spark ML: baselines, boosted trees, calibration, contributions."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import NUMERIC
from ..operators.metrics import average_precision_by, scalars
from ..operators.sampling import draw, fraction_sample, holdout_split
from ..sources.shared import names_in, publish, published, ranged, write_once

LABEL = "is_attributed"
SENTINEL, ABOVE = -1.0, 1e12  # below and above every real value; MLlib routes no nulls
#: Features that may be missing, and the suffixes of their forms in the trees.
NULLABLE = {n for n in NUMERIC if "conversion_rate" in n or n in ("f2_inter_click_time_seconds", "f2_ip_click_std_inter_arrival")}
LOW, HIGH = "__low", "__high"
F1F2 = [n for n in NUMERIC if n.startswith(("f1_", "f2_"))]


def score_random(df: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    return df.withColumn("p", draw(key, seed))


def score_pair_rate(train: DataFrame, df: DataFrame, feature: str = "f3_ip_app_conversion_rate_24hr") -> DataFrame:
    """The rate itself; pairs without history get the train base rate."""
    prior = train.agg(F.avg(F.col(LABEL).cast("double")).alias("__prior"))
    return df.join(F.broadcast(prior), how="cross").withColumn("p", F.coalesce(feature, "__prior")).drop("__prior")  # one row


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(SENTINEL)) for n in features}).withColumn("label", F.col(LABEL).cast("double"))


def weighted(train: DataFrame) -> DataFrame:
    """Class weights n / (2 * n_class)."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    return train.join(F.broadcast(counts.select("label", (F.lit(float(n)) / (2 * F.col("c"))).alias("weight"))), "label")  # two rows


def fit_logreg(train: DataFrame, features: list[str] = F1F2, max_iter: int = 100) -> PipelineModel:
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1e-4, probabilityCol="probability")]
    return Pipeline(stages=steps).fit(weighted(filled(train, features)))


def tree_columns(features: list[str]) -> list[str]:
    """What the trees see: a form of each feature with missing values below all others, and of those that may be missing one with them above.

    A split of either form sends the missing values to a side of its own choice: each split learns its side.
    """
    return [*(f"{n}{LOW}" for n in features), *(f"{n}{HIGH}" for n in features if n in NULLABLE)]


def _feature_of(column: str) -> str:
    return column.removesuffix(LOW).removesuffix(HIGH)


def with_both_sides(df: DataFrame, features: list[str]) -> DataFrame:
    """df with tree_columns and the label; the features themselves stay as they are."""
    return df.withColumns({c: F.coalesce(F.col(_feature_of(c)).cast("double"), F.lit(ABOVE if c.endswith(HIGH) else SENTINEL)) for c in tree_columns(features)} | {"label": F.col(LABEL).cast("double")})


def staged(model: PipelineModel, df: DataFrame, rounds: Iterable[int]) -> DataFrame:
    """(rounds, p, y_true): the scores of the first so many trees, for each number of rounds, from one pass over df."""
    boosted = model.stages[-1]
    out = model.stages[0].transform(df).select("features", F.col("label").cast("int").alias("y_true"))
    for i, tree in enumerate(boosted.trees):
        out = tree.copy({tree.featuresCol: "features", tree.predictionCol: f"__t{i}"}).transform(out)
    weights = boosted.treeWeights
    margins = []
    for i, w in enumerate(weights):
        margins.append((margins[-1] if margins else F.lit(0.0)) + F.lit(float(w)) * F.col(f"__t{i}"))
    # A boosted tree's margin is half the log odds.
    stages = F.array(*[F.struct(F.lit(n).alias("rounds"), (1 / (1 + F.exp(-2 * margins[n - 1]))).alias("p")) for n in rounds if n <= len(weights)])
    return out.select("y_true", F.inline(stages))


def first_trees(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model of the first so many trees."""
    whole = model.stages[-1]
    sc = SparkContext._active_spark_context
    kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(kind, rounds), sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = whole._java_obj.trees()[i], float(whole.treeWeights[i])
    java = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid, trees, weights, whole.numFeatures, 2)
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(java)])


def fit_trees(train: DataFrame, val: DataFrame, features: list[str] = NUMERIC, rounds: int | tuple[int, ...] = 20, depth: int = 5, step: float = 0.1, seed: int = 42, min_rows: int = 1, feature_share: float = 1.0, row_share: float = 0.8, min_gain: float = 0.0, max_bins: int = 32) -> tuple[PipelineModel, float]:
    """Boosted trees, stopped where the average precision on val is best: among all numbers of rounds up to rounds, or among those given.

    One fit. The scores after every tree are taken in one pass over val, and the first trees up to the best number are the model; of equal
    numbers the smallest.
    """
    counts = range(1, rounds + 1) if isinstance(rounds, int) else sorted(rounds)
    # Only what the trees read is kept, as vectors: not the columns that they are made of, some twice as many bytes a row.
    assembler = VectorAssembler(inputCols=tree_columns(features), outputCol="features")
    data = assembler.transform(weighted(with_both_sides(train, features))).select("features", "label", "weight").cache()
    boosted = GBTClassifier(weightCol="weight", maxIter=max(counts), maxDepth=depth, stepSize=step, subsamplingRate=row_share, featureSubsetStrategy=str(float(feature_share)), minInstancesPerNode=min_rows, minInfoGain=min_gain, maxBins=max_bins, seed=seed)
    model = PipelineModel([assembler, boosted.fit(data)])
    data.unpersist()
    found = average_precision_by(staged(model, with_both_sides(val, features), counts), "rounds").orderBy(F.desc_nulls_last("pr_auc"), "rounds").first()
    return (model, 0.0) if found is None else (first_trees(model, found["rounds"]), found["pr_auc"] or 0.0)


def tune(train: DataFrame, val: DataFrame, features: list[str] = NUMERIC, grid: dict | None = None, share: float = 0.25, seed: int = 42) -> DataFrame:
    """(depth, step, rounds, pr_auc) of each setting of a grid on a seeded subsample, best first."""
    grid = grid or {"depth": (3, 5), "step": (0.1, 0.3), "rounds": (10,)}
    part = fraction_sample(train, share, seed).cache()
    rows = []
    for depth, step, rounds in itertools.product(grid["depth"], grid["step"], grid["rounds"]):
        rows.append((depth, step, rounds, float(fit_trees(part, val, features, (rounds,), depth, step, seed)[1])))
    part.unpersist()
    return train.sparkSession.createDataFrame(rows, "depth int, step double, rounds int, pr_auc double").orderBy(F.desc("pr_auc"), "depth", "step", "rounds")


def settings(trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws of the seven parameters; the ranges are fixed values, those over several powers of ten are drawn evenly by their logarithm."""
    r = random.Random(seed)
    log = lambda low, high: math.exp(r.uniform(math.log(low), math.log(high)))
    return [
        {"depth": r.randint(3, 8), "step": log(0.01, 0.2), "min_rows": round(log(20, 500)), "feature_share": r.uniform(0.5, 1.0), "row_share": r.uniform(0.5, 1.0), "min_gain": log(1e-6, 1e-2), "max_bins": r.choice((32, 64, 128))}
        for _ in range(trials)
    ]


TRIALS = "trial int, rung int, share double, depth int, step double, min_rows int, feature_share double, row_share double, min_gain double, max_bins int, rounds int, pr_auc double"


def halving_search(train: DataFrame, val: DataFrame, path: str, features: list[str] = NUMERIC, trials: int = 9, keep: int = 3, rounds: int = 20, share: float = 0.15, seed: int = 42, at_once: int = 2) -> DataFrame:
    """The trial table of a search by successive halving: all settings on a small sample of train, the best 1 / keep of them on one keep times as large, and so on.

    Trials of a rung run side by side. Each is a row of the table at path as soon as it is done; a search that is repeated there, with the same
    seed, fits only what is missing. Rows are sorted by rung from the last, best first; the first row is the setting to take.
    """
    spark, drawn = train.sparkSession, settings(trials, seed)

    def rows_of(rung: int) -> dict[int, dict]:
        found = [published(spark, f"{path}/{n}") for n in names_in(spark, path) if n.startswith(f"s{seed}-r{rung}-")]
        return {r["trial"]: r for r in map(json.loads, found)}

    def run(trial: int, rung: int, part: DataFrame, part_share: float) -> None:
        model, value = fit_trees(part, val, features, rounds, seed=seed, **drawn[trial])
        row = {"trial": trial, "rung": rung, "share": part_share} | drawn[trial] | {"rounds": len(model.stages[-1].treeWeights), "pr_auc": float(value)}
        publish(spark, f"{path}/s{seed}-r{rung}-{trial}.json", json.dumps(row))

    rung, alive, rows = 0, list(range(trials)), []
    while True:
        part_share = min(1.0, share * keep**rung)
        if missing := sorted(set(alive) - set(rows_of(rung))):
            part = fraction_sample(train, part_share, seed).cache()
            with ThreadPoolExecutor(at_once) as pool:
                list(pool.map(inheritable_thread_target(spark)(lambda t, part=part: run(t, rung, part, part_share)), missing))
            part.unpersist()
        done = sorted((r for t, r in rows_of(rung).items() if t in alive), key=lambda r: (-r["pr_auc"], r["trial"]))
        rows = [*done, *rows]
        if len(alive) == 1:
            break
        alive, rung = [r["trial"] for r in done[: max(1, len(alive) // keep)]], rung + 1
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in TRIALS.split(", ")) for r in rows], TRIALS)


def ablation(train: DataFrame, val: DataFrame, rounds: int = 10, features: list[str] = NUMERIC, at_once: int = 2) -> DataFrame:
    """(without, pr_auc, delta): refits without each feature family, so many side by side: the jobs of one fill the cores that another's short ones leave idle."""
    families = {"none": features} | {f: [n for n in features if not n.startswith(f)] for f in ("f1_", "f2_", "f3_")}
    fit = inheritable_thread_target(train.sparkSession)(lambda names: float(fit_trees(train, val, names, (rounds,))[1]))
    with ThreadPoolExecutor(at_once) as pool:
        value = dict(zip(families, pool.map(fit, families.values()), strict=True))
    return train.sparkSession.createDataFrame([(k, v, v - value["none"]) for k, v in value.items()], "without string, pr_auc double, delta double")


def importance(model: PipelineModel, features: list[str], df: DataFrame | None = None) -> DataFrame:
    """(feature, gain[, mean_abs]) by gain, and by the mean absolute contribution over df."""
    gains: dict[str, float] = dict.fromkeys(features, 0.0)
    for f, g in zip(tree_columns(features), model.stages[-1].featureImportances.toArray(), strict=True):
        gains[_feature_of(f)] += float(g)
    out = _session().createDataFrame(list(gains.items()), "feature string, gain double")
    if df is not None:
        c = tree_contributions(model, df, features, len(features)).select(F.explode("top_features").alias("t"))
        out = out.join(c.groupBy(F.col("t.feature_name").alias("feature")).agg(F.avg(F.abs("t.shap_contribution")).alias("mean_abs")), "feature", "left")
    return out.orderBy(F.desc("gain"), "feature")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def predict(model: PipelineModel, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """df with p = P(attributed) and y_true. features: fill them first."""
    trees = features is not None and isinstance(model.stages[-1], GBTClassificationModel)
    out = model.transform((with_both_sides if trees else filled)(df, features) if features else df)
    return out.withColumns({"p": vector_to_array("probability")[1], "y_true": F.col("label").cast("int")}).drop(*(tree_columns(features) if trees else []))


def save_bundle(model: PipelineModel, features: list[str], path: str) -> None:
    """The model and the names of its features, in order."""
    model.write().overwrite().save(f"{path}/model")
    _session().createDataFrame([(i, f) for i, f in enumerate(features)], "at int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_bundle(path: str) -> tuple[PipelineModel, list[str]]:
    rows = _session().read.schema("at int, feature string").parquet(f"{path}/features").orderBy("at").collect()
    return PipelineModel.load(f"{path}/model"), [r["feature"] for r in rows]


def fit_calibrator(scored: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol="p", labelCol="y_true", isotonic=True).fit(scored.select(F.col("p").cast("double").alias("p"), F.col("y_true").cast("double").alias("y_true")))


BLOCKS = "part long, low double, high double, y double, n double"


def _pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators: neighbouring blocks, by rising score, whose means do not rise become one."""
    out: list[list[float]] = []
    for part, low, high, y, n in blocks.sort_values("low")[["part", "low", "high", "y", "n"]].itertuples(index=False):
        out.append([part, low, high, y, n])
        while len(out) > 1 and out[-2][3] * out[-1][4] >= out[-1][3] * out[-2][4]:
            _, _, high_, y_, n_ = out.pop()
            out[-1][2:] = [high_, out[-1][3] + y_, out[-1][4] + n_]
    return pd.DataFrame(out, columns=["part", "low", "high", "y", "n"])


def isotonic_blocks(scored: DataFrame, together: int = 16) -> DataFrame:
    """(low, high, y, n): the blocks of the isotonic regression of y_true on p, each a range of scores with one mean.

    Scores are counted by distinct value and range-partitioned; each range pools its own. Blocks that are pooled stay pooled when more scores come
    to them, so neighbouring ranges are then pooled together, so many at a time, until one is left. Means of whole counts that rise strictly are
    at most about n^(2/3) in number: that many blocks meet in the last step, not rows.
    """
    counted = ranged(scored.groupBy(F.col("p").cast("double").alias("low")).agg(F.sum(F.col("y_true").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n")), "low")
    blocks = counted.select(F.col("__part").cast("long").alias("part"), "low", F.col("low").alias("high"), "y", "n")
    while True:
        blocks = write_once(blocks.groupBy("part").applyInPandas(_pool, BLOCKS), "blocks")
        last = blocks.agg(F.max("part")).first()[0]
        if not last:
            return blocks.drop("part")
        blocks = blocks.withColumn("part", F.expr(f"part div {together}"))


def isotonic_knots(scored: DataFrame) -> DataFrame:
    """(x, y): the ends of each block and its mean. A table, whatever its size; the calibrator is the line through them."""
    mean = F.col("y") / F.col("n")
    ends = F.array(F.struct(F.col("low").alias("x"), mean.alias("y")), F.struct(F.col("high").alias("x"), mean.alias("y")))
    return isotonic_blocks(scored).select(F.inline(ends)).distinct()


def knots(model: IsotonicRegressionModel) -> DataFrame:
    """(x, y) of a model of Spark ML."""
    return _session().createDataFrame([(float(x), float(y)) for x, y in zip(model.boundaries, model.predictions, strict=True)], "x double, y double")


def save_knots(table: DataFrame | IsotonicRegressionModel, path: str) -> None:
    (table if isinstance(table, DataFrame) else knots(table)).write.mode("overwrite").parquet(path)


def read_knots(path: str) -> DataFrame:
    return _session().read.schema("x double, y double").parquet(path)


def load_knots(path: str) -> list[tuple[float, float]]:
    """A small calibrator as a list."""
    return [(r["x"], r["y"]) for r in read_knots(path).orderBy("x").collect()]


def apply_knots(p: Column, table: list[tuple[float, float]]) -> Column:
    """Linear interpolation between a few knots, clipped to [0, 1] and flat outside."""
    table = sorted(table)
    at = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in table])
    k = F.size(F.filter(at, lambda s: s["x"] <= p))
    low, high = F.get(at, F.greatest(k - 1, F.lit(0))), F.get(at, F.least(k, F.lit(len(table) - 1)))
    slope = F.when(high["x"] > low["x"], (p - low["x"]) / (high["x"] - low["x"])).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), low["y"] + (high["y"] - low["y"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), slope))))


def with_calibrated(df: DataFrame, table: DataFrame | list[tuple[float, float]], column: str, p: str = "p", cells: int = 4096) -> DataFrame:
    """df with the calibrated p in a column: as apply_knots, by a join with the pieces between knots.

    [0, 1] is cut into cells; a piece is listed in each cell that it meets, so rows and pieces meet by an equal cell and a range. The pieces are
    broadcast by their size or shuffled, as Spark decides; they are never collected. A missing score stays missing.
    """
    spark = df.sparkSession
    table = table if isinstance(table, DataFrame) else spark.createDataFrame(table, "x double, y double")
    order = Window.orderBy("x", "y")  # over the knots only
    pieces = table.select(F.col("x").alias("__x0"), F.col("y").alias("__y0"), F.lead("x").over(order).alias("__x1"), F.lead("y").over(order).alias("__y1"), F.lag("x").over(order).isNull().alias("__first"))
    cell = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    edge = pieces.where("__first").select(F.lit(float("-inf")).alias("__x0"), F.col("__y0"), F.col("__x0").alias("__x1"), F.col("__y0").alias("__y1"))
    inner = pieces.select("__x0", "__y0", F.coalesce("__x1", F.lit(float("inf"))).alias("__x1"), F.coalesce("__y1", "__y0").alias("__y1")).where("__x1 > __x0")
    listed = write_once(edge.unionByName(inner).withColumn("__cell", F.explode(F.sequence(cell(F.col("__x0")), cell(F.col("__x1"))))), "pieces")
    v = F.col(p).cast("double")
    flat = (F.col("__x0") == float("-inf")) | (F.col("__x1") == float("inf"))
    line = F.when(flat, F.col("__y0")).otherwise(F.col("__y0") + (F.col("__y1") - F.col("__y0")) * ((v - F.col("__x0")) / (F.col("__x1") - F.col("__x0"))))
    met = df.withColumn("__cell_of", cell(v)).join(listed, (F.col("__cell_of") == F.col("__cell")) & (v >= F.col("__x0")) & (v < F.col("__x1")), "left")
    return met.withColumn(column, F.when(line.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), line)))).drop("__cell_of", *listed.columns)


def calibration_report(scored: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    """(name, n, ..., brier) before and after calibration on the half that the calibrator has not seen."""
    fit_on, test_on = holdout_split(scored, seed, key=key)
    table = isotonic_knots(fit_on)
    return scalars(test_on, "raw").unionByName(scalars(with_calibrated(test_on, table, "p"), "calibrated"))


def final_report(val: DataFrame, test: DataFrame, table: DataFrame | list[tuple[float, float]]) -> DataFrame:
    """Raw and calibrated metrics of the test split and the raw ones of val, with the gap to val."""
    parts = scalars(val, "val").unionByName(scalars(test, "test_raw")).unionByName(scalars(with_calibrated(test, table, "p"), "test_calibrated"))
    base = parts.where("name = 'val'").select(F.col("pr_auc").alias("__v"))
    return parts.join(F.broadcast(base), how="cross").withColumn("pr_auc_gap", F.col("pr_auc") - F.col("__v")).drop("__v")  # one row


def _top(items: list[tuple[str, Column, Column]], k: int) -> Column:
    parts = F.array(*[F.struct(F.lit(n).alias("feature_name"), v.cast("string").alias("value"), c.alias("shap_contribution")) for n, v, c in items])
    order = lambda a, b: F.when(F.abs(a["shap_contribution"]) > F.abs(b["shap_contribution"]), -1).when(F.abs(a["shap_contribution"]) < F.abs(b["shap_contribution"]), 1).otherwise(F.when(a["feature_name"] < b["feature_name"], -1).otherwise(1))
    return F.slice(F.array_sort(parts, order), 1, k)


def linear_contributions(model: PipelineModel, df: DataFrame, features: list[str] = F1F2, k: int = 5) -> DataFrame:
    """df with top_features: the k largest coefficient * scaled value of each row."""
    out = predict(model, df, features)
    scaled = vector_to_array("features")
    beta = model.stages[-1].coefficients.toArray()
    return out.withColumn("__x", scaled).withColumn("top_features", _top([(n, F.col(n), F.lit(float(b)) * F.col("__x")[i]) for i, (n, b) in enumerate(zip(features, beta, strict=True))], k)).drop("__x")


def tree_contributions(model: PipelineModel, df: DataFrame, features: list[str] = NUMERIC, k: int = 5) -> DataFrame:
    """df with top_features: how much the margin moves when a feature is set to its mean (occlusion, not Shapley values).

    Each row becomes one row a feature, so give it routed rows only. They are written once with a number, so both sides of the join have the same.
    """
    base = write_once(with_both_sides(df, features).withColumn("__id", F.monotonically_increasing_id()), "explained")
    means = base.agg(*[F.avg(n).alias(n) for n in features]).first()
    which = F.explode(F.array(F.lit(""), *map(F.lit, features)))
    swapped = {c: F.when(F.col("__out") == _feature_of(c), F.lit(SENTINEL if means[_feature_of(c)] is None else float(means[_feature_of(c)]))).otherwise(F.col(c)) for c in tree_columns(features)}
    wide = base.withColumn("__out", which).withColumns(swapped)
    margin = vector_to_array(F.col("rawPrediction"))[1]
    m = model.transform(wide.select("__id", "__out", *tree_columns(features))).select("__id", "__out", margin.alias("m"))
    one = m.groupBy("__id").agg(*[F.max(F.when(F.col("__out") == n, F.col("m"))).alias(f"__m_{n}") for n in ["", *features]])
    joined = base.join(one, "__id")
    return joined.withColumn("top_features", _top([(n, F.col(n), F.col("__m_") - F.col(f"__m_{n}")) for n in features], k)).drop("__id", *tree_columns(features), *[f"__m_{n}" for n in ["", *features]])
