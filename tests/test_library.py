"""Metrics, triage, audit, store, validation, sampling, models."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.operators import metrics, quality, sampling, triage
from tidewater.plans import models
from tidewater.plans.materialize import enforce, feature_table, materialize_features, pipeline
from tidewater.sources import audit
from tidewater.sources.clicks import from_events, split_predicate
from tidewater.sources.store import FeatureStore, feature_columns


def scored(spark, rows):
    return spark.createDataFrame([(i, float(p), y, 1 - float(p), y) for i, (p, y) in enumerate(rows)], "case_id long, p double, y_true int, fraud_score double, label int")


def test_perfect_and_constant_scores(spark):
    row = metrics.scalars(scored(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)]), "x").first()
    assert (row["pr_auc"], row["roc_auc"]) == (1.0, 1.0)
    half = metrics.scalars(scored(spark, [(0.5, i % 4 == 0) for i in range(100)] and [(0.5, int(i % 4 == 0)) for i in range(100)]), "x").first()
    assert half["pr_auc"] == pytest.approx(0.25) and half["roc_auc"] == pytest.approx(0.5) and half["brier"] == pytest.approx(0.25)


def test_one_class(spark):
    assert metrics.scalars(scored(spark, [(0.5, 1), (0.7, 1)]), "x").first()["roc_auc"] is None
    with pytest.raises(ValueError):
        metrics.evaluate(scored(spark, [(0.5, 0)]), "x")
    with pytest.raises(ValueError):
        metrics.evaluate(spark.createDataFrame([(None, 1)], "p double, y_true int"), "x")


def test_curves_are_bounded(spark):
    r = random.Random(1)
    df = scored(spark, [(r.random(), int(r.random() < 0.3)) for _ in range(3000)]).cache()
    assert metrics.pr_curve(df, 100).count() <= 103
    assert metrics.calibration_curve(df).agg(F.sum("n")).first()[0] == 3000
    assert metrics.calibration_curve(df.limit(1)).count() == 0
    got = metrics.evaluate(df, "x")
    assert len(got["confusion"]) == 7 and got["n"] == 3000


def test_sweep_equals_single_policies(spark):
    r = random.Random(2)
    df = scored(spark, [(r.choice([0, 1, 0.02, 0.5, r.random()]), int(r.random() < 0.2)) for _ in range(500)]).cache()
    surface = {(q["t_block"], q["t_review"]): q for q in triage.sweep(df).collect()}
    assert len(surface) == 51 * 52 // 2
    for block, review in ((1.0, 0.0), (0.5, 0.5), (0.98, 0.02), (0.0, 0.0)):
        one = triage.expected_cost(df, block, review).first()
        assert one["total_cost"] == pytest.approx(surface[block, review]["total_cost"]) and one["n_reviewed"] == surface[block, review]["n_reviewed"]
    best = triage.best(triage.sweep(df)).first()
    assert best["total_cost"] == pytest.approx(min(q["total_cost"] for q in surface.values()))
    with pytest.raises(ValueError):
        triage.expected_cost(df, 0.1, 0.2)
    with pytest.raises(ValueError):
        triage.best_capped(triage.sweep(df), -1)


def test_costs_by_hand(spark):
    df = scored(spark, [(0.1, 1), (0.9, 0), (0.4, 1), (0.1, 0)])
    one = triage.expected_cost(df, 0.8, 0.5).first()
    assert (one["n_blocked"], one["n_reviewed"], one["n_allowed"], one["false_positives"], one["false_negatives"]) == (2, 1, 1, 1, 1)
    assert one["total_cost"] == pytest.approx(1.1) and one["cost_per_click"] == pytest.approx(0.275)
    assert triage.expected_cost(df.limit(0), 0.8, 0.5).first()["cost_per_click"] == 0


def test_routing(spark):
    df = scored(spark, [(0.2, 0), (0.4, 0), (0.9, 1)])
    assert [r["action"] for r in triage.route(df, 0.8, 0.6, 0).orderBy("case_id").collect()] == ["AUTO_BLOCK", "HUMAN_REVIEW", "ALLOW"]
    many = spark.range(20000).select(F.col("id").alias("case_id"), F.lit(0.0).alias("fraud_score"))
    first = triage.route(many, 0.8, 0.6, 0.1)
    share = first.where("action = 'QA_SAMPLE'").count() / 20000
    assert abs(share - 0.1) < 0.01
    assert triage.route(many.repartition(7), 0.8, 0.6, 0.1).exceptAll(first).count() == 0
    for bad in (lambda: triage.route(df, 0.8, 0.6, 1.5), lambda: triage.route(df, 0.5, 0.6)):
        with pytest.raises(ValueError):
            bad()


def test_audit(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    base = scored(spark, [(0.1, 0), (0.3, 0), (0.99, 1)]).withColumns({"raw_score": F.col("p"), "calibrated_score": F.col("p"), "click_time": F.lit("2024-01-01").cast("timestamp_ntz")})
    rows = audit.rows(triage.route(base, 0.8, 0.6, 0), "m", "p", 0.8, 0.6)
    assert audit.append(rows, path) == 2
    assert audit.append(rows.limit(0), path) == 0
    assert audit.read(spark, path).count() == 2 and audit.read(spark, path).select("event_id").distinct().count() == 2
    assert [r["case_id"] for r in audit.review_queue(audit.read(spark, path)).collect()] == ["1"]
    for change in ({"action": F.lit("MAYBE")}, {"raw_score": F.lit(1.5)}, {"case_id": F.lit(None).cast("string")}):
        with pytest.raises(ValueError):
            audit.append(rows.withColumns(change), path)


def test_store(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    df = spark.range(5).select(F.col("id").alias("row_id"), F.lit(1).alias("f1_app_id"), F.lit(2).alias("label"))
    for v in ("v0.2.0", "v0.10.0"):
        store.save(df, v, "train", "test")
    assert store.versions() == ["v0.2.0", "v0.10.0"]
    assert feature_columns(store.load("v0.2.0", "train")) == ["f1_app_id"]
    hashes = {r["content_hash"] for r in store.metadata().collect()}
    assert len(hashes) == 1
    df.write.parquet(f"file://{tmp_path}/other")
    store.register(f"file://{tmp_path}/other", "v1.0.0", "val", "elsewhere")
    assert store.load("v1.0.0", "val").count() == 5
    with pytest.raises(Exception, match="exist"):
        store.save(df, "v0.2.0", "train", "test")
    with pytest.raises(FileNotFoundError, match="v0.10.0"):
        store.load("v3.0.0", "train")
    for version, split in (("0.1", "train"), ("v1.0.0", "../x")):
        with pytest.raises(ValueError):
            store.save(df, version, split, "x")


def test_validation(spark, sf):
    clicks = from_events(spark, sf)
    good = quality.summary(clicks, (0.1, 0.3), ("2024-01-01 00:00:00", "2024-02-01 00:00:00"))
    assert good["ok"] and good["row_count"] == clicks.count() and not good["errors"]
    bad = quality.summary(clicks.withColumns({"ip": F.expr("nullif(ip, 1)"), "is_attributed": F.lit(2).cast("byte")}))
    failed = {c["name"] for c in bad["checks"] if not c["ok"]}
    assert failed == {"not_null_ip", "label_values", "time_range", "class_balance"}
    assert not quality.summary(clicks.limit(0))["ok"]
    with pytest.raises(ValueError):
        quality.exactly_one(spark.range(2))


def test_samples(spark, sf):
    clicks = from_events(spark, sf)
    a, b = (sampling.stratified_sample(clicks.repartition(n), 0.2).select("row_id") for n in (2, 5))
    assert a.exceptAll(b).count() == 0 and a.count() >= clicks.count() * 0.2
    left, right = sampling.holdout_split(clicks)
    assert left.count() + right.count() == clicks.count() and left.join(right, "row_id").count() == 0
    for f in (0, 1, -1):
        with pytest.raises(ValueError):
            sampling.stratified_sample(clicks, f)


def test_calibration(spark):
    r = random.Random(3)
    rows = [(i, p, int(r.random() < p * p)) for i, p in enumerate(r.random() for _ in range(2000))]
    df = spark.createDataFrame(rows, "row_id long, p double, y_true int")
    model = models.fit_calibrator(df)
    table = [(q["x"], q["y"]) for q in models.knots(model).collect()]
    got = df.withColumn("c", models.apply_knots(F.col("p"), table)).orderBy("p").collect()
    assert all(0 <= a["c"] <= b["c"] <= 1 for a, b in zip(got, got[1:]))
    own = {q["row_id"]: q["prediction"] for q in model.transform(df).collect()}
    assert all(abs(own[q["row_id"]] - q["c"]) < 1e-9 for q in got)
    report = {q["name"]: q["brier"] for q in models.calibration_report(df).collect()}
    assert report["calibrated"] < report["raw"]


def test_plans(spark, sf, tmp_path):
    clicks = from_events(spark, sf)
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    n = materialize_features(clicks, store, "v0.1.0", "train", "events")
    assert n == materialize_features(clicks, store, "v0.1.0", "train", "events") == clicks.where(split_predicate("train")).count()
    assert pipeline(clicks, f"file://{tmp_path}/log") == clicks.where(split_predicate("val")).count()
    train, val = store.load("v0.1.0", "train"), feature_table(clicks, "val")
    model, value = models.fit_trees(train, val, rounds=(2,), depth=2)
    mix = enforce(spark, model, val, f"file://{tmp_path}/acted", rate=0.2)
    logged = audit.read(spark, f"file://{tmp_path}/acted")
    assert logged.count() == sum(v for k, v in mix.items() if k != "ALLOW") and logged.where("size(top_features) = 5").count() == logged.count()
    assert models.importance(model, models.NUMERIC).count() == len(models.NUMERIC)


def test_streams_take_files_in_any_order(spark, sf, tmp_path):
    """Part files with the newest days first and days mixed: no row is late, and the counts are those of the one sorted file."""
    from tidewater.queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts", ascending=False)
    (tmp_path / "events.parquet").mkdir()
    cut = len(events) // 3
    for i, part in enumerate((events[:cut], events[cut::2], events[cut + 1 :: 2])):
        part.to_parquet(tmp_path / "events.parquet" / f"part-{i}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "events.parquet" / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        for name in ("x2_stream_prior_features", "x3_stream_route"):
            whole, shuffled = (sorted(map(str, QUERIES[name](spark, str(d)).collect())) for d in (sf, tmp_path))
            assert shuffled == whole
            if name.startswith("x2"):
                assert len(shuffled) == len(events)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def signal(spark):
    """(train, val) where f1 tells the label, f2 a little and f3 nothing."""
    r = random.Random(6)
    rows = []
    for i in range(900):
        y = int(r.random() < 0.4)
        rows.append((i, y, r.gauss(2 * y, 1), r.gauss(0.3 * y, 1), r.gauss(0, 1)))
    df = spark.createDataFrame(rows, "row_id long, is_attributed int, f1_a double, f2_b double, f3_c double").cache()
    return df.where("row_id < 600"), df.where("row_id >= 600")


NAMES = ["f1_a", "f2_b", "f3_c"]


def test_linear_model(signal):
    """The signs of the coefficients, a high area, and contributions that are coefficient times scaled value and add up to the margin."""
    import numpy as np

    train, val = signal
    model = models.fit_logreg(train, NAMES)
    beta, scaler = model.stages[-1].coefficients.toArray(), model.stages[1]
    assert beta[0] > 1 and beta[0] > beta[1] > abs(beta[2]) - 0.2
    assert metrics.scalars(models.predict(model, val, NAMES), "x").first()["roc_auc"] > 0.85
    for r in models.linear_contributions(model, val, NAMES, 3).limit(20).collect():
        own = {t["feature_name"]: t["shap_contribution"] for t in r["top_features"]}
        want = beta * (np.array([r[n] for n in NAMES]) - scaler.mean.toArray()) / scaler.std.toArray()
        assert [own[n] for n in NAMES] == pytest.approx(list(want))
        assert np.log(r["p"] / (1 - r["p"])) == pytest.approx(want.sum() + model.stages[-1].intercept)


def test_tree_models(signal, spark, tmp_path):
    """Rounds are chosen on val; contributions are margins with a feature at its mean; importance, tuning, ablation, bundles."""
    train, val = signal
    model, value = models.fit_trees(train, val, NAMES, rounds=(1, 4), depth=2)
    each = [models.fit_trees(train, val, NAMES, rounds=(n,), depth=2)[1] for n in (1, 4)]
    assert value == pytest.approx(max(each)) and value > 0.7
    part = val.limit(10).cache()
    found = models.tree_contributions(model, part, NAMES, 3).collect()
    margin = lambda df: {r["row_id"]: float(r["rawPrediction"][1]) for r in models.predict(model, df, NAMES).collect()}
    base, means = margin(part), part.agg(*[F.avg(n).alias(n) for n in NAMES]).first()
    for n in NAMES:
        at_mean = margin(part.withColumn(n, F.lit(means[n])))
        for r in found:
            assert next(t["shap_contribution"] for t in r["top_features"] if t["feature_name"] == n) == pytest.approx(base[r["row_id"]] - at_mean[r["row_id"]])
    ranked = models.importance(model, NAMES, val.limit(30)).collect()
    assert ranked[0]["feature"] == "f1_a" and sum(r["gain"] for r in ranked) == pytest.approx(1) and max(ranked, key=lambda r: r["mean_abs"] or 0)["feature"] == "f1_a"
    tuned = models.tune(train, val, NAMES, {"depth": (1, 2), "step": (0.1,), "rounds": (2,)}, share=0.5).collect()
    assert len(tuned) == 2 and tuned[0]["pr_auc"] >= tuned[1]["pr_auc"]
    without = {r["without"]: r["delta"] for r in models.ablation(train, val, 2, NAMES).collect()}
    assert without["none"] == 0 and without["f1_"] < -0.1 and without["f1_"] == min(without.values())
    models.save_bundle(model, NAMES, f"file://{tmp_path}/bundle")
    again, names = models.load_bundle(f"file://{tmp_path}/bundle")
    assert names == NAMES and margin(part) == {r["row_id"]: float(r["rawPrediction"][1]) for r in models.predict(again, part, names).collect()}


def test_reports(signal, spark, tmp_path):
    train, val = signal
    scored = models.predict(models.fit_logreg(train, NAMES), val, NAMES).withColumn("p", F.col("p") * 0.5)
    calibrator = models.fit_calibrator(scored)
    models.save_knots(calibrator, f"file://{tmp_path}/knots")
    table = models.load_knots(f"file://{tmp_path}/knots")
    assert table == [(r["x"], r["y"]) for r in models.knots(calibrator).collect()]
    report = {r["name"]: r for r in models.final_report(scored, scored, table).collect()}
    assert report["test_raw"]["pr_auc_gap"] == pytest.approx(0) and report["test_calibrated"]["brier"] < report["test_raw"]["brier"]
    one, two = (sorted((r["row_id"], r["c"]) for r in df.collect()) for df in (models.with_calibrated(scored, table, "c"), scored.withColumn("c", models.apply_knots(F.col("p"), table))))
    assert [r[0] for r in one] == [r[0] for r in two] and [r[1] for r in one] == pytest.approx([r[1] for r in two])


def test_metric_bundle_as_json(spark, tmp_path):
    r = random.Random(8)
    got = metrics.evaluate(scored(spark, [(r.random(), int(r.random() < 0.3)) for _ in range(500)]), "x")
    metrics.save_json(got, spark, f"file://{tmp_path}/m")
    import json

    assert json.loads(spark.read.text(f"file://{tmp_path}/m").first()[0]) == got


def test_reuse_is_of_the_same_input(spark, sf, tmp_path):
    clicks, store = from_events(spark, sf), FeatureStore(spark, f"file://{tmp_path}/store")
    part = clicks.where("row_id <= 300").cache()
    n = materialize_features(part, store, "v0.1.0", "train", "events")
    assert materialize_features(part.repartition(5), store, "v0.1.0", "train", "events") == n
    with pytest.raises(ValueError, match="other input"):
        materialize_features(part.where("row_id <> 7"), store, "v0.1.0", "train", "events")
