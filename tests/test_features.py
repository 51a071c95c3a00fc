"""Known answers and edges of the strictly prior windows."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions.features import FEATURES, all_features, feature
from tidewater.functions.registry import Feature, FeatureSet, Registry, attach
from tidewater.operators.windows import DAY, HOUR, presence_counts, prior_count, prior_rate, sliced_prior, timed
from tidewater.sources.clicks import apply_split, split_predicate, with_row_id

BASE = datetime(2024, 1, 2)
SCHEMA = "row_id long, ip int, app int, device int, os int, channel int, click_time timestamp_ntz, attributed_time timestamp_ntz, is_attributed byte"


def clicks(spark, rows):
    """rows: (ip, app, device, seconds after BASE, label)."""
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    data = [(i + 1, ip, app, dev, dev, app, BASE + timedelta(microseconds=round(t * 1e6)), None, y) for i, (ip, app, dev, t, y) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def values(df, *names):
    return [tuple(r) for r in df.orderBy("row_id").select(*names).collect()]


def brute(rows, key, span, item=None):
    out = []
    for r in rows:
        t = round(r["click_time"].timestamp() * 1e6)
        own = [q for q in rows if all(q[k] == r[k] for k in key) and (span is None or t - span <= round(q["click_time"].timestamp() * 1e6)) and round(q["click_time"].timestamp() * 1e6) <= t - 1000]
        out.append(len({q[item] for q in own}) if item else len(own))
    return out


def test_five_clicks(spark):
    out = all_features(clicks(spark, [(1, 1, 0, 10 * i, 0) for i in range(5)]))
    assert values(out, "f2_clicks_per_ip_last_1hr") == [(0,), (1,), (2,), (3,), (4,)]
    assert values(out, "f2_inter_click_time_seconds") == [(None,), (10,), (10,), (10,), (10,)]
    assert values(out, "f3_ip_conversion_rate_24hr")[0] == (None,)
    assert values(out, "f2_ip_click_std_inter_arrival") == [(None,), (None,), (None,), (0.0,), (0.0,)]


def test_burst_needs_more_than_ten(spark):
    out = all_features(clicks(spark, [(1, 1, 0, 10 * i, 0) for i in range(12)]))
    assert [b for (b,) in values(out, "f2_burst_score")] == [0] * 11 + [1]


def test_deviation_equals_the_definition(spark):
    """One hot ip, gaps of nothing, of seconds and of months: sample deviation of the gaps of the day before, by the statistics module."""
    r = random.Random(4)
    at, rows = 0.0, []
    for _ in range(300):
        at += r.choice([0, 0, 1, r.random(), r.randint(1, 400), r.randint(20_000, 80_000), 9_000_000])
        rows.append((1 if r.random() < 0.8 else 2, 1, 0, at, 0))
    df = feature(clicks(spark, rows), "f2_ip_click_std_inter_arrival").join(feature(clicks(spark, rows), "f2_inter_click_time_seconds"), "row_id").join(clicks(spark, rows), "row_id")
    found = [(x["ip"], round(x["click_time"].timestamp() * 1e6), x["f2_inter_click_time_seconds"], x["f2_ip_click_std_inter_arrival"]) for x in df.orderBy("row_id").collect()]
    several = 0
    for ip, t, _, got in found:
        gaps = [g for i, u, g, _ in found if i == ip and t - DAY <= u <= t - 1000 and g is not None]
        several += len(gaps) > 2
        assert got == (pytest.approx(statistics.stdev(gaps), rel=1e-12) if len(gaps) > 1 else None)
    assert several > 50


def test_edges_and_peers(spark):
    """Same time is not seen; 1 ms before is; exactly a day before is, a microsecond more is not."""
    rows = [(1, 1, 0, 0, 1), (1, 2, 1, 0, 0), (1, 3, 2, 0.0005, 0), (1, 4, 3, 0.001, 0), (1, 5, 4, 86400, 0), (1, 6, 5, 86400.000001, 0), (1, 7, 6, 86400.0015, 0)]
    df = clicks(spark, rows)
    out = all_features(df)
    assert [n for (n,) in values(out, "f2_clicks_per_ip_last_24hr")] == brute(df.orderBy("row_id").collect(), ["ip"], DAY)
    for name, item in (("f3_ip_distinct_apps_24hr", "app"), ("f3_ip_distinct_devices_24hr", "device")):
        assert [n for (n,) in values(out, name)] == brute(df.orderBy("row_id").collect(), ["ip"], DAY, item)


@pytest.mark.parametrize("seed", range(3))
def test_three_ways_agree(spark, seed):
    """Prefix differences, time slices and presence segments against a loop, with hot keys and near-edge times."""
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2]), r.randint(0, 3), r.choice([0, 86400, 172800]) + r.choice([0, 0.0004, 0.001, 0.0015, 30, 3600, r.random() * 90000]), r.randint(0, 1)) for _ in range(60)]
    df = clicks(spark, rows)
    own = df.orderBy("row_id").collect()
    assert [n for (n,) in values(timed(df).withColumn("n", prior_count(["app"], HOUR)), "n")] == brute(own, ["app"], HOUR)
    sliced = sliced_prior(df, "app", F.col("is_attributed"), {"h": HOUR, "d": DAY, "a": None}, slice_us=2 * HOUR)
    for name, span in (("h_n", HOUR), ("d_n", DAY), ("a_n", None)):
        assert [n for (n,) in values(sliced, name)] == brute(own, ["app"], span)
    assert [n for (n,) in values(presence_counts(df, "app", {"n": "ip"}), "n")] == brute(own, ["app"], DAY, "ip")
    assert [n for (n,) in values(presence_counts(df, "app", {"n": "ip"}, slice_us=2 * HOUR), "n")] == brute(own, ["app"], DAY, "ip")
    out = values(all_features(df), "f3_app_conversion_rate_24hr", "f3_app_conversion_rate_alltime", "f3_app_clicks_alltime", "f3_app_distinct_ips_24hr")
    plain = timed(df).withColumns({"a": prior_rate(F.col("is_attributed"), ["app"], DAY), "b": prior_rate(F.col("is_attributed"), ["app"], None), "c": prior_count(["app"], None)})
    assert [r[:3] for r in out] == values(plain, "a", "b", "c") and [r[3] for r in out] == brute(own, ["app"], DAY, "ip")


@pytest.mark.parametrize("rows", [[], [(1, 1, 0, 0, 1)]])
def test_tiny_tables(spark, rows):
    out = all_features(clicks(spark, rows))
    assert out.count() == len(rows)
    assert {n: t for n, t in out.dtypes if n in FEATURES} == FEATURES


def test_later_rows_do_not_matter(spark):
    rows = [(1, i % 2, i % 3, 1000 * i, i % 2) for i in range(10)]
    early = values(all_features(clicks(spark, rows)), *FEATURES)
    late = values(all_features(clicks(spark, rows + [(1, 1, 1, 20000 + i, 1) for i in range(20)])), *FEATURES)
    assert late[: len(early)] == early


def test_splits_see_earlier_history(spark):
    before = (datetime(2024, 1, 18, 23, 59, 50) - BASE).total_seconds()
    out = all_features(clicks(spark, [(1, 1, 0, before + i, 0) for i in range(5)] + [(1, 1, 0, before + 10, 0)]))
    assert values(out.where(split_predicate("val")), "f2_clicks_per_ip_last_24hr") == [(5,)]
    with pytest.raises(ValueError):
        split_predicate("dev")
    with pytest.warns(UserWarning):
        apply_split(out, "test")


def test_row_ids_are_contiguous(spark):
    df = clicks(spark, [(i % 3, i, 0, 1800 * (7 * i % 20), 0) for i in range(40)])
    got = with_row_id(df.drop("row_id")).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1, 41))
    assert [(r["click_time"], r["ip"]) for r in got] == sorted((r["click_time"], r["ip"]) for r in got)


def test_feature_sets(spark):
    df = clicks(spark, [(1, 1, 0, i, 0) for i in range(3)])
    a = Feature("a", "SELECT row_id, ip + 1 AS value FROM {source}", "int")
    b = Feature("b", lambda d: F.col("a") * 2, "int", dependencies=("a",))
    assert values(FeatureSet([b, a]).compute(spark, df), "a", "b") == [(2, 4)] * 3
    for bad in ([a, a], [b], [Feature("x", "", "int", dependencies=("y",)), Feature("y", "", "int", dependencies=("x",))]):
        with pytest.raises(ValueError):
            FeatureSet(bad)
    reg = Registry()
    reg.register(a)
    with pytest.raises(ValueError):
        reg.register(a)
    for sql in ("SELECT row_id, 1 AS v FROM {s}", "SELECT row_id, 1 AS value FROM {s} WHERE row_id > 1", "SELECT row_id + 5 AS row_id, 1 AS value FROM {s}"):
        with pytest.raises(ValueError):
            attach(df, spark.sql(sql, s=df), "x", "int")


def test_row_ids_of_equal_rows(spark):
    df = clicks(spark, [(1, 1, 1, 0, 0)] * 30).drop("row_id")
    assert sorted(r["row_id"] for r in with_row_id(df).collect()) == list(range(1, 31))


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles(spark, seed):
    """Ties, gaps, nulls and few values; against numpy's interpolation."""
    import numpy as np

    from tidewater.operators.quantiles import exact_quantiles

    r = random.Random(seed)
    rows = [r.choice([0.0, 1.0, r.random(), r.gauss(0, 1000)]) for _ in range([5000, 7, 1][seed])]
    shares = [0.0, 0.01, 0.1, 0.5, 0.77, 0.995, 1.0]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "x double").repartition(3)
    assert exact_quantiles(df, "x", shares) == pytest.approx([float(np.quantile(rows, q)) for q in shares])
    assert exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_spread_of_gaps_beyond_twenty_bits(spark):
    """Squares are summed in parts of longs, exact for gaps of weeks and of years; no measure is a decimal."""
    import statistics

    from tidewater.functions.features import IP_MEASURES

    at = [0, 3_456_001, 3_456_011, 3_456_031, 1_003_456_031, 1_003_456_038, 1_003_456_100]
    got = values(all_features(clicks(spark, [(1, 1, 0, t, 0) for t in at])), "f2_ip_click_std_inter_arrival")
    assert [g[0] for g in got] == [None, None, None, pytest.approx(statistics.stdev([3_456_001, 10]), rel=1e-14), None, None, pytest.approx(statistics.stdev([10**9, 7]), rel=1e-14)]
    assert {m.kind for m in IP_MEASURES.values()} == {"bigint"}
