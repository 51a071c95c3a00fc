"""Hot keys cut into time slices, passes that go on after a failure, sinks that may be run again, streams that let their state go."""

import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_features import brute, clicks, values

from tidewater.functions import features
from tidewater.functions.features import FEATURES, PASSES, all_features, feature, with_edges, with_ip_features
from tidewater.operators import profile
from tidewater.operators.windows import DAY, asof_last, presence_counts, sessionize
from tidewater.plans.materialize import KeptPasses, feature_table, input_version, materialize_features
from tidewater.queries import scored
from tidewater.sources import audit
from tidewater.sources.clicks import from_events, split_predicate
from tidewater.sources.shared import publish, published
from tidewater.sources.store import FeatureStore
from tidewater.streaming import velocity


def hot_rows(n=400, seed=9):
    """One ip in half of the rows and one app in most; times in bursts, at slice edges, at span edges and equal."""
    import random

    r = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(n):
        at += r.choice([0, 0, 0.0005, 0.001, 0.0015, 1, 59, 3600, 3599.9995, r.random() * 9000, 86400 * (r.random() < 0.05)])
        rows.append((1 if r.random() < 0.5 else r.randint(2, 30), r.choice([1, 1, 1, 2, 3]), r.randint(0, 3), at, int(r.random() < 0.3)))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    return clicks(spark, hot_rows()).cache()


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_features_of_hot_keys(hot, limit):
    """Cut into slices of a few rows or not at all, all 28 features are the same."""
    assert values(all_features(hot, limit), *FEATURES) == values(all_features(hot), *FEATURES)


def test_hot_keys_against_a_loop(hot):
    own = hot.orderBy("row_id").collect()
    for name, key, item in (("f2_clicks_per_ip_last_24hr", ["ip"], None), ("f3_ip_app_clicks_24hr", ["ip", "app"], None), ("f3_ip_distinct_devices_24hr", ["ip"], "device"), ("f3_app_distinct_ips_24hr", ["app"], "ip")):
        assert [n for (n,) in values(feature(hot, name, limit=5), name)] == brute(own, key, DAY, item)
    assert [n for (n,) in values(presence_counts(hot, "ip", {"n": "os"}, slice_us=1_000), "n")] == brute(own, ["ip"], DAY, "os")


def test_no_task_holds_a_hot_key(spark):
    """Half of the rows have one ip: no window over rows is by ip alone, rows are not joined back by row_id, and no task has over twice the median."""
    rows = [(1 if i % 2 else i % 160, 1, 0, 30 * i, 0) for i in range(8000)]
    df = clicks(spark, rows)
    out = with_ip_features(with_edges(df, limit=50), limit=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"\], \[ip#\d+L?\], \[", plan) and not re.search(r"Join.*row_id", plan)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        sizes = [r["count"] for r in with_ip_features(with_edges(df, limit=50), limit=50).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 1 and sum(sizes) == 8000 and max(sizes) <= 2 * statistics.median(sizes)
    whole = all_features(df, 50)
    assert not re.search(r"Join.*row_id", whole._jdf.queryExecution().executedPlan().toString())


def test_asof_of_a_hot_key(spark):
    """Against a loop: slices without a value take the last one of earlier slices, null values among them."""
    rows = hot_rows(200, 3)
    left = clicks(spark, rows)
    right = left.where("is_attributed = 1").groupBy("ip", "click_time").agg(F.max("app").alias("bought"))
    right = right.withColumn("bought", F.when(F.col("bought") != 2, F.col("bought")))
    known = [(r["ip"], r["click_time"], r["bought"]) for r in right.collect()]
    expected = {}
    for r in left.collect():
        before = [(t, b) for ip, t, b in known if ip == r["ip"] and t <= r["click_time"] - timedelta(milliseconds=1)]
        expected[r["row_id"]] = max(before, key=lambda x: x[0])[1] if before else None
    for limit in (1, 9, 10_000):
        got = asof_last(left, right, "ip", "click_time", "click_time", "bought", 1000, limit)
        assert {r["row_id"]: r["bought"] for r in got.collect()} == expected


@pytest.mark.parametrize("gap", [1_000, 60_000_000, DAY])
def test_sessions_of_a_hot_key(hot, gap):
    whole, cut = (sorted(map(tuple, sessionize(hot, "ip", gap, limit).collect())) for limit in (10_000, 3))
    assert cut == whole and sum(r[4] for r in whole) == 400
    for ip, _, first, last, n in whole:
        assert n == 1 or last >= first


def test_gaps_of_a_hot_key(hot, monkeypatch):
    plain = [r["value"] for r in profile.inter_click_time(hot).collect()]
    monkeypatch.setattr(profile, "sliced", lambda df, key: features.sliced(df, key, 4))
    assert [r["value"] for r in profile.inter_click_time(hot).collect()] == pytest.approx(plain)


# Passes


def counted(monkeypatch, fail=()):
    """PASSES, with the names of those that run, and failing ones."""
    ran = []

    def wrap(name, run):
        def step(df, limit):
            ran.append(name)
            if name in fail:
                raise RuntimeError("lost")
            return run(df, limit)

        return step

    monkeypatch.setattr(features, "PASSES", {n: wrap(n, f) for n, f in PASSES.items()})
    return ran


def test_a_broken_build_goes_on(spark, hot, tmp_path, monkeypatch):
    store, root = FeatureStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/store/passes"
    with monkeypatch.context() as m:
        assert counted(m, fail=("app",)) == []
        with pytest.raises(RuntimeError):
            materialize_features(hot, store, "v0.1.0", "train", "t")
    with monkeypatch.context() as m:
        ran = counted(m)
        for split in ("train", "val", "test"):
            materialize_features(hot.repartition(3), store, "v0.1.0", split, "t")
        assert ran == ["app"]
    for split in ("train", "val"):
        assert values(store.load("v0.1.0", split), *FEATURES) == values(feature_table(hot, split), *FEATURES)
    with monkeypatch.context() as m:
        ran = counted(m)
        other = hot.where("row_id <> 5")
        kept = KeptPasses(spark, root, input_version(other))
        assert feature_table(other, kept=kept).count() == 399 and ran == ["edges", "ip", "app"] and kept.made == 3


def test_a_pass_without_a_manifest_is_not_read(spark, hot, tmp_path):
    kept = KeptPasses(spark, f"file://{tmp_path}/p", "x")
    hot.limit(3).write.parquet(f"{kept.root}/edges-broken")
    assert kept.keep("edges", lambda: hot).count() == 400 and kept.made == 1
    assert KeptPasses(spark, f"file://{tmp_path}/p", "x").keep("edges", lambda: pytest.fail("made again")).count() == 400


def test_published_files(spark, tmp_path):
    path = f"file://{tmp_path}/a/b"
    assert published(spark, path) is None
    publish(spark, path, "first")
    publish(spark, path, "second")
    assert published(spark, path) == "first"


# Store


def test_adoption_reads_no_row(spark, hot, tmp_path):
    path, store = f"file://{tmp_path}/elsewhere", FeatureStore(spark, f"file://{tmp_path}/store")
    hot.select("row_id", F.col("app").alias("f1_app_id")).write.parquet(path)
    plan = spark.read.parquet(path).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    store.register(path, "v1.0.0", "val", "elsewhere")
    row = store.metadata().first()
    assert (row["n_rows"], row["columns"], row["content_hash"]) == (400, ["row_id", "f1_app_id"], None)
    assert not (tmp_path / "elsewhere").exists() and store.load("v1.0.0", "val").count() == 400
    with pytest.raises(FileExistsError):
        store.register(f"file://{tmp_path}/store/v1.0.0/val.parquet", "v1.0.0", "val", "again")


def test_a_save_that_broke_off_can_be_repeated(spark, hot, tmp_path, monkeypatch):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    with monkeypatch.context() as m:
        m.setattr(FeatureStore, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.save(hot.limit(10), "v1.0.0", "train", "t")
    assert store.versions() == []
    store.save(hot, "v1.0.0", "train", "t")
    assert store.metadata().first()["n_rows"] == store.load("v1.0.0", "train").count() == 400


# Audit log and streams


def entries(df):
    routed = scored(df).withColumns({"raw_score": F.col("p"), "calibrated_score": F.col("p"), "action": F.lit("HUMAN_REVIEW")})
    return audit.rows(routed, "m", "p", 0.8, 0.6)


def test_a_batch_is_in_the_log_once(spark, hot, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    with monkeypatch.context() as m:
        m.setattr(audit, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            audit.append(entries(hot), path, "s-0")
    assert audit.read(spark, path).count() == 0  # written, not committed
    assert [audit.append(entries(hot), path, b) for b in ("s-0", "s-0", "s-1")] == [400, 400, 400]
    assert audit.read(spark, path).groupBy("case_id").count().where("count <> 2").count() == 0
    with pytest.raises(ValueError, match="not in"):
        audit.append(entries(hot).withColumn("raw_score", F.lit(2.0)), path, "s-2")
    with pytest.raises(ValueError, match="name"):
        audit.append(entries(hot), path, "../x")
    assert audit.read(spark, path).count() == 800


@pytest.fixture()
def few_state_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def stream_of(spark, tmp_path, parts):
    """Each part, a list of (row_id, ip, seconds, label), as one file, in order."""
    schema = "row_id long, ip int, click_time timestamp, is_attributed int"
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(parts):
        rows = [(r, ip, datetime(2024, 1, 2) + timedelta(seconds=s), y) for r, ip, s, y in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/part{i}")
        next((tmp_path / f"part{i}").glob("part-*.parquet")).rename(folder / f"part-{i:05d}-x.parquet")
    return velocity.file_stream(spark, f"file://{folder}", spark.createDataFrame([], schema).schema)


def test_routing_after_a_failure(spark, tmp_path, few_state_partitions, monkeypatch):
    """The second batch fails after its rows are written and before they are committed; the restarted stream leaves each case once."""
    parts = [[(10 * p + i, 1, 60 * (10 * p + i), 0) for i in range(10)] for p in range(3)]
    stream = stream_of(spark, tmp_path, parts).select(F.col("row_id").alias("case_id"), "click_time", F.lit(0.1).alias("p"))
    args = (stream, f"file://{tmp_path}/log", 0.8, 0.6)
    commit = audit.publish
    with monkeypatch.context() as m:
        m.setattr(audit, "publish", lambda s, path, text: commit(s, path, text) if path.endswith("-0") else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            velocity.stream_route(spark, *args, checkpoint=f"file://{tmp_path}/cp").awaitTermination()
    assert audit.read(spark, args[1]).count() == 10
    velocity.stream_route(spark, *args, checkpoint=f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(int(r["case_id"]) for r in audit.read(spark, args[1]).collect()) == list(range(30))


def test_window_state_goes_and_late_clicks_are_kept(spark, tmp_path, few_state_partitions):
    hour = 3600
    parts = [[(100 * d + i, i % 5, 24 * hour * d + i * hour // 2, 0) for i in range(40)] for d in range(6)]
    parts[4] += [(900, 1, 10, 0), (901, 2, 24 * hour * 5, 0), (902, 1, 24 * hour * 3 + hour * 30, 0)]  # days late, in time, its window still open
    parts.append([(999, None, 24 * hour * 12, 0)])
    sizes = []
    counts = velocity.windowed_counts(stream_of(spark, tmp_path, parts))
    query = counts.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out/n={i}")).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) < 100 and sizes[-1] == 1  # of 241 windows
    out = spark.read.parquet(f"file://{tmp_path}/out").agg(F.sum("n_clicks")).first()[0]
    late = velocity.late_clicks(spark, velocity.file_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], "row_id long, ip int, click_time timestamp, is_attributed int").schema), "late").collect()
    assert [(r["row_id"], r["batch"]) for r in late] == [(900, 4)] and out == 240 + 2


def test_prior_state_of_a_hot_ip(spark, tmp_path, few_state_partitions):
    """Against a loop, over several batches; a batch writes only the buckets that it has clicks in, and timers remove old ones."""
    import random

    r = random.Random(2)
    at, rows = 0.0, []
    for i in range(300):
        at += r.choice([0, 0.001, 0.0005, 100, 3600, 7200.5, 86400 * (r.random() < 0.03)])
        rows.append((i, 1 if r.random() < 0.8 else 2, round(at, 4), int(r.random() < 0.4)))
    got = velocity.run_to_table(spark, velocity.prior_features(stream_of(spark, tmp_path, [rows[:120], rows[120:121], rows[121:]])), "prior", rocksdb=True).collect()
    us = lambda s: round(s * 1e6)
    for x in got:
        _, ip, t, _ = rows[x["row_id"]]
        own = [y for _, i, s, y in rows if i == ip and us(t) - DAY <= us(s) <= us(t) - 1000]
        assert x["clicks_before"] == len(own) and x["rate_before"] == (pytest.approx(sum(own) / len(own)) if own else None)
    assert len(got) == 300


def test_prior_state_is_called_by_shard_and_hour(spark, tmp_path, few_state_partitions):
    """The state of many ips is read and written a few times a shard and hour, not once and more an ip; a click without an ip counts as one ip's."""
    import numpy as np
    import pandas as pd

    calls = []

    class Kept(dict):
        def containsKey(self, k):
            calls.append(k)
            return k in self

        def getValue(self, k):
            calls.append(k)
            return self[k]

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    one = velocity.PriorCounts(DAY, DAY // 24)
    states = {"totals": Kept(), "rows": Kept()}
    one.init(type("Handle", (), {"getMapState": lambda self, name, *_: states[name], "registerTimer": lambda self, at: calls.append(at)})())
    ips, n = np.arange(5000) % 2500, 5000
    at = pd.Timestamp("2024-01-02") + pd.to_timedelta(np.arange(n), unit="s")
    out = pd.concat(one.handleInputRows((0,), iter([pd.DataFrame({"row_id": np.arange(n), "click_time": at, "is_attributed": 1, "ip_code": ips})]), None))
    assert out["clicks_before"].tolist() == [0] * 2500 + [1] * 2500 and len(calls) < 200
    got = velocity.run_to_table(spark, velocity.prior_features(stream_of(spark, tmp_path, [[(1, None, 0, 1), (2, 0, 5, 0)], [(3, None, 60, 0)]])), "prior", rocksdb=True)
    assert sorted(map(tuple, got.collect())) == [(1, None, 0, None), (2, 0, 0, None), (3, None, 1, 1.0)]


def test_turns_are_batches_of_many_files(spark, tmp_path):
    """A turn is several files, none empty, all of it in one batch; with few rows it is one file."""
    clicks = spark.range(2_000).select(F.col("id").alias("row_id"), F.lit(1).alias("ip"), F.timestamp_seconds("id").alias("click_time"))
    turn = F.when(F.col("row_id") % 10 != 0, 0).when(F.col("row_id") % 20 == 0, 1).otherwise(2)
    for rows, files in ((20, 5), (1000, 1)):
        path = f"file://{tmp_path}/in{files}"
        assert velocity.write_turns(clicks, turn, 3, path, rows) == files
        assert len(list((tmp_path / f"in{files}").glob("part-*.parquet"))) == 3 * files
        batches = []
        stream = velocity.file_stream(spark, path, clicks.schema, files)
        stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/cp{files}").trigger(availableNow=True).foreachBatch(lambda b, i, batches=batches: batches.append({r[0] for r in b.select(turn).distinct().collect()})).start().awaitTermination()
        assert batches == [{0}, {1}, {2}]


def test_a_known_input_is_not_hashed_again(spark, tmp_path, monkeypatch):
    from tidewater.plans import materialize

    rows = clicks(spark, [(1, 1, 0, 60 * i, 0) for i in range(5)])
    store, version = FeatureStore(spark, f"file://{tmp_path}/store"), input_version(rows)
    monkeypatch.setattr(materialize, "input_version", lambda c: pytest.fail("hashed"))
    assert materialize_features(rows, store, "v0.1.0", "train", "t", made_from=version) == materialize_features(rows, store, "v0.1.0", "train", "t", made_from=version)
