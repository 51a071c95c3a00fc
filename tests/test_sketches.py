"""Sketches by hour: updates that read new hours only, merge to what one update gives, and keep to their error bounds."""

import random

import pytest
from pyspark.sql import functions as F
from test_features import clicks

from tidewater.operators import profile, sketches
from tidewater.operators.sketches import HourlySketches, distinct_error


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(5)
    return clicks(spark, [(r.randint(0, 900), r.randint(0, 30), r.randint(0, 3), 40.0 * i + r.random(), int(r.random() < 0.3)) for i in range(6000)]).withColumn("attributed_time", F.when(F.col("is_attributed") == 1, F.col("click_time") + F.make_dt_interval(secs=F.col("row_id") % 500))).cache()


STEPS = ("2024-01-02 06:00:00", "2024-01-03 00:00:00", "2024-01-06 00:00:00")


@pytest.fixture(scope="module")
def kept(spark, many, tmp_path_factory):
    out = HourlySketches(spark, f"file://{tmp_path_factory.mktemp('sketches')}")
    assert out.closed() is None
    with pytest.raises(FileNotFoundError):
        out.hours()
    assert sum(out.update(many, s) for s in STEPS) == many.where(F.col("click_time") < F.lit(STEPS[-1]).cast("timestamp_ntz")).count() == 6000
    return out


def test_distinct_counts_keep_their_bound(kept, many):
    exact = {r["column_name"]: r["n_distinct"] for r in profile.cardinality(many).collect()}
    for r in kept.cardinality().collect():
        assert abs(r["n_distinct"] - exact[r["column_name"]]) <= 1 + distinct_error(exact[r["column_name"]])
    day = many.where("click_time >= '2024-01-02 06:00:00' AND click_time < '2024-01-03 00:00:00'")
    exact = day.select(F.count_distinct("ip")).first()[0]
    got = {r["column_name"]: r["n_distinct"] for r in kept.cardinality("2024-01-02 06:00:00", "2024-01-03 00:00:00").collect()}["ip"]
    assert abs(got - exact) <= 1 + distinct_error(exact)


@pytest.mark.parametrize("measure,exact", [("gap_seconds", profile.inter_click_time), ("lag_seconds", profile.attributed_lag)])
def test_statistics_keep_their_bound(kept, many, measure, exact):
    """Count, least, mean and largest are exact, gaps over the ends of updates among them; quantiles are off by under 2 % of the ranks."""
    want, got = ({r["stat"]: r["value"] for r in d.collect()} for d in (exact(many), kept.statistics(measure)))
    assert [got[k] for k in ("count", "min", "mean", "max")] == pytest.approx([want[k] for k in ("count", "min", "mean", "max")])
    if measure == "gap_seconds":
        by_ip = {}
        for r in many.orderBy("row_id").select("ip", F.unix_micros(F.col("click_time").cast("timestamp")).alias("t")).collect():
            by_ip.setdefault(r["ip"], []).append(r["t"])
        values = sorted((b - a) / 1e6 for ts in by_ip.values() for a, b in zip(ts, ts[1:]))
    else:
        values = sorted(float(r["row_id"] % 500) for r in many.where("is_attributed = 1").collect())
    for name, q in profile.QUANTILES.items():
        assert sum(v < got[name] for v in values) <= (q + 0.02) * len(values) and sum(v <= got[name] for v in values) >= (q - 0.02) * len(values)


def test_updates_add_up(spark, many, kept, tmp_path):
    whole = HourlySketches(spark, f"file://{tmp_path}/s")
    whole.update(many, STEPS[-1])
    one, other = ({r["column_name"]: r["n_distinct"] for r in k.cardinality().collect()} for k in (whole, kept))
    assert all(abs(one[c] - other[c]) <= distinct_error(one[c], 1.0) for c in one)  # the order of merging matters a little
    assert whole.hours().count() == kept.hours().count() == many.select(F.date_trunc("hour", "click_time")).distinct().count()
    for bad in (STEPS[-1], "2024-01-01 00:00:00", "2024-02-01 00:30:00"):
        with pytest.raises(ValueError):
            whole.update(many, bad)


def test_an_update_reads_new_hours_only(spark, many, tmp_path, monkeypatch):
    """The filter on time reaches the scan, and an update that breaks off leaves nothing in force."""
    many.write.parquet(f"file://{tmp_path}/clicks")
    table, kept, seen = spark.read.parquet(f"file://{tmp_path}/clicks"), HourlySketches(spark, f"file://{tmp_path}/s"), []
    kept.update(table, STEPS[0])
    spy = sketches.neighbours
    monkeypatch.setattr(sketches, "neighbours", lambda df, *a: (seen.append(df), spy(df, *a))[1])
    with monkeypatch.context() as m:
        m.setattr(sketches, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            kept.update(table, STEPS[1])
    assert kept.closed() == STEPS[0]
    assert kept.update(table, STEPS[1]) > 0
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()  # cuts long lists of filters short
    assert "PushedFilters: [IsNotNull(click_time), LessThan(click_time,2024-01-03T00:00), GreaterThanOrEqual(click_time,2024" in plan
