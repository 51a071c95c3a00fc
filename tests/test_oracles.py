"""Every query that has SQL gives DuckDB's rows; the others run."""

import pytest
from oracle import connect, same

from tidewater.queries import ORACLES, QUERIES
from tidewater.sources.clicks import from_events, split_predicate


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_models_without_sql(spark, sf):
    """What has no SQL: metrics of whole splits, reports of the same rows, contributions that are ordered and explain every row."""
    val = from_events(spark, sf).where(split_predicate("val"))
    n, positive = val.count(), val.where("is_attributed = 1").count()
    for name in ("l3_logreg", "l5_boosted_trees"):
        row = QUERIES[name](spark, sf).first()
        assert (row["n"], row["n_positive"]) == (n, positive) and 0 < row["pr_auc"] <= 1 and 0 <= row["roc_auc"] <= 1 and 0 < row["brier"] < 1
    linear = QUERIES["l10_linear_contributions"](spark, sf).collect()
    assert len({r["row_id"] for r in linear}) == len(linear) == n
    trees = QUERIES["l11_tree_contributions"](spark, sf).collect()
    assert 0 < len(trees) <= n
    for r in linear[:50] + trees[:50]:
        size = [abs(t["shap_contribution"]) for t in r["top_features"]]
        assert len(size) == 5 and size == sorted(size, reverse=True)
    report = {r["name"]: r for r in QUERIES["c1_calibration"](spark, sf).collect()}
    assert report["raw"]["n"] == report["calibrated"]["n"] and report["calibrated"]["brier"] < report["raw"]["brier"]
    trials = QUERIES["l6_tune"](spark, sf).collect()
    assert [r["rung"] for r in trials] == [2] + [1] * 3 + [0] * 9 and all(0 <= r["pr_auc"] <= 1 for r in trials)
    assert {r["without"]: r["delta"] for r in QUERIES["l7_ablation"](spark, sf).collect()}["none"] == 0
    assert sum(r["gain"] for r in QUERIES["l8_importance"](spark, sf).collect()) == pytest.approx(1)
    final = {r["name"]: r for r in QUERIES["k9_final_report"](spark, sf).collect()}
    test = from_events(spark, sf).where(split_predicate("test"))
    assert final["val"]["n"] == n and final["val"]["pr_auc_gap"] == 0 and final["test_raw"]["n"] == final["test_calibrated"]["n"] == test.count()
    assert final["test_calibrated"]["brier"] < final["test_raw"]["brier"]
    assert QUERIES.keys() - ORACLES.keys() == {"l3_logreg", "l5_boosted_trees", "l6_tune", "l7_ablation", "l8_importance", "k9_final_report", "l10_linear_contributions", "l11_tree_contributions"}


def test_entry_has_unique_columns(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
