"""Boosted trees that stop in time, the search over their settings, isotonic blocks that merge, and rules of the curves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import NAMES, signal  # noqa: F401

from tidewater.operators import metrics
from tidewater.plans import models


def test_best_number_of_rounds(signal):  # noqa: F811
    """The one staged fit finds what a fit for every number of rounds finds, and its first trees score as that fit does."""
    train, val = signal
    model, value = models.fit_trees(train, val, NAMES, rounds=5, depth=2)
    each = {n: models.fit_trees(train, val, NAMES, rounds=(n,), depth=2) for n in range(1, 6)}
    best = max(each, key=lambda n: (each[n][1], -n))
    assert len(model.stages[-1].treeWeights) == best and value == pytest.approx(each[best][1])
    one, other = (sorted((r["row_id"], r["p"]) for r in models.predict(m, val, NAMES).collect()) for m in (model, each[best][0]))
    assert [p for _, p in one] == pytest.approx([p for _, p in other])


def test_missing_values_choose_their_side(spark):
    """Missing is like high in one feature and like low in the other: a tree of one split gets both right."""
    low, high = "f2_inter_click_time_seconds", "f3_ip_conversion_rate_24hr"
    r = random.Random(1)
    for name, miss in ((low, 1), (high, 0)):
        rows = [(i, *((None, miss) if i % 3 == 0 else (lambda v: (v, int(v > 0.5)))(r.random()))) for i in range(300)]
        df = spark.createDataFrame(rows, f"row_id long, {name} double, is_attributed int")
        model, value = models.fit_trees(df, df, [name], rounds=1, depth=1)
        assert value > 0.98
        assert models.importance(model, [name]).collect() == [(name, pytest.approx(1))]


def test_search_goes_on(signal, spark, tmp_path, monkeypatch):  # noqa: F811
    train, val = signal
    args = (train, val, f"file://{tmp_path}/trials", NAMES)
    small = {"trials": 4, "keep": 2, "rounds": 2, "share": 0.5}
    calls = []
    fit = models.fit_trees

    def counted(*a, **k):
        calls.append(k)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return fit(*a, **k)

    monkeypatch.setattr(models, "fit_trees", counted)
    with pytest.raises(RuntimeError):
        models.halving_search(*args, **small, at_once=1)
    first = models.halving_search(*args, **small).collect()
    assert len(calls) == 3 + 2 + 2 + 1  # two of the first rung were kept; two on the next rung, one on the last
    again = models.halving_search(*args, **small).collect()
    assert again == first and len(calls) == 8
    assert [r["rung"] for r in first] == [2, 1, 1, 0, 0, 0, 0] and first[0]["pr_auc"] > 0.5
    assert {r["trial"] for r in first if r["rung"] == 1} == {r["trial"] for r in sorted((r for r in first if r["rung"] == 0), key=lambda r: -r["pr_auc"])[:2]}
    elsewhere = models.halving_search(train, val, f"file://{tmp_path}/other", NAMES, **small).collect()
    assert elsewhere == first
    drawn = models.settings(50)
    assert drawn == models.settings(50) != models.settings(50, 1) and all(len(s) == 7 and 0.01 <= s["step"] <= 0.2 and 20 <= s["min_rows"] <= 500 for s in drawn)


def pav(points):
    blocks = []
    for x, y, n in points:
        blocks.append([x, x, y, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, hi, y_, n_ = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + y_, blocks[-1][3] + n_]
    return blocks


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "one", "ties"])
def test_isotonic_blocks(spark, kind):
    """Pooled in ranges and merged, the blocks are those of one pass over all scores."""
    r = random.Random(4)
    p = {"noise": lambda: r.random(), "rising": lambda: r.random(), "falling": lambda: r.random(), "one": lambda: 0.5, "ties": lambda: r.randint(0, 9) / 10}[kind]
    y = {"rising": lambda p: int(p > 0.5), "falling": lambda p: int(p < 0.5)}.get(kind, lambda p: int(r.random() < p))
    rows = [(i, v, y(v)) for i, v in enumerate(p() for _ in range(600))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "row_id long, p double, y_true int")
        found = sorted(tuple(b) for b in models.isotonic_blocks(df, together=2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    points = [(v, sum(q[2] for q in rows if q[1] == v), sum(q[1] == v for q in rows)) for v in sorted({q[1] for q in rows})]
    assert found == [tuple(map(float, b)) for b in pav(points)]


def test_calibrating_by_ranges(spark):
    """As numpy's interpolation, at knots, between, outside, beyond [0, 1] and for missing scores."""
    table = [(0.1, 0.0), (0.45, 0.35), (0.6, 0.35), (0.6000001, 0.5), (0.95, 1.0)]
    xs = [0.0, 0.1, 0.2, 0.45, 0.5, 0.6, 0.60000005, 0.7, 0.95, 0.99, 1.0, -3.0, 4.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, p double")
    got = {r["i"]: r["c"] for r in models.with_calibrated(df, table, "c", cells=8).collect()}
    assert len(got) == len(xs) + 1 and got.pop(len(xs)) is None
    assert [got[i] for i in range(len(xs))] == pytest.approx(list(np.interp(xs, *zip(*table))))
    one = models.with_calibrated(df, [(0.5, 0.3)], "c").where("p IS NOT NULL").select("c").distinct().collect()
    assert [r["c"] for r in one] == [0.3]


@pytest.mark.parametrize("n", [2, 19, 20, 47, 150])
def test_bins_follow_the_number_of_rows(spark, n):
    r = random.Random(n)
    rows = [(r.random(), int(r.random() < 0.4)) for _ in range(n)]
    bins = min(10, max(2, n // 10))
    edges = np.percentile([p for p, _ in rows], np.linspace(0, 100, bins + 1))[1:-1]
    want = {}
    for p, y in rows:
        want.setdefault(int(np.searchsorted(edges, p)), []).append((p, y))
    got = {x["bin"]: (x["n"], x["mean_score"], x["positive_fraction"]) for x in metrics.calibration_curve(spark.createDataFrame(rows, "p double, y_true int")).collect()}
    assert got == {b: (len(v), pytest.approx(np.mean([p for p, _ in v])), pytest.approx(np.mean([y for _, y in v]))) for b, v in want.items()}


@pytest.mark.parametrize("n,points", [(5, 10), (9, 10), (10, 10), (11, 10), (57, 10)])
def test_points_are_evenly_spaced(spark, n, points):
    df = spark.createDataFrame([(i / n, i % 2) for i in range(n)], "p double, y_true int")
    got = sorted(r["at"] for r in metrics.pr_curve(df, points).collect())
    assert got == (list(range(n + 1)) if n + 1 <= points else sorted({i * n // (points - 1) for i in range(points)})) and len(got) == min(n + 1, points)
    assert metrics.pr_curve(df, points).where("threshold IS NULL").collect()[0]["recall"] == 0


def test_precision_of_several_scorings_at_once(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, round(r.random(), 1 + k), int(r.random() < 0.3)) for k in range(3) for _ in range(200)], "k int, p double, y_true int")
    got = {x["k"]: x["pr_auc"] for x in metrics.average_precision_by(df, "k").collect()}
    assert got == {k: pytest.approx(metrics.average_precision(df.where(F.col("k") == k)).first()[0]) for k in range(3)}


def test_ablation_fits_side_by_side(signal, monkeypatch):
    """Two refits at once: each waits until another has begun."""
    import threading

    two = threading.Barrier(2)
    monkeypatch.setattr(models, "fit_trees", lambda train, val, names, rounds: (two.wait(30), (None, len(names) / 10))[1])
    got = {r["without"]: (r["pr_auc"], round(r["delta"], 6)) for r in models.ablation(*signal, 2, NAMES).collect()}
    assert got == {"none": (0.3, 0.0), "f1_": (0.2, -0.1), "f2_": (0.2, -0.1), "f3_": (0.2, -0.1)}


def test_trees_keep_vectors_only(signal, monkeypatch):
    seen, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, data, *a: (seen.append(data.columns), fit(self, data, *a))[1])
    models.fit_trees(*signal, NAMES, rounds=1, depth=1)
    assert seen == [["features", "label", "weight"]]
