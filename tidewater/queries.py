"""Registered queries over the events table as clicks, and their SQL for DuckDB. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import FEATURES, NUMERIC, PASSES, feature
from .functions.registry import Feature, FeatureSet, Registry
from .operators import metrics, profile, quality, sampling, triage
from .operators.sketches import HourlySketches, distinct_error
from .operators.windows import DAY, SLICE_ROWS, asof_last, neighbours, presence_counts, prior_rate, sessionize, sliced, sliced_prior, timed
from .plans import materialize, models
from .sources import audit
from .sources.clicks import apply_split, create_split_views, from_events, ingest_csv, read_csv, split_predicate, split_ranges, with_row_id, write_csv
from .sources.shared import shared_path, write_once
from .sources.store import FeatureStore, feature_columns
from .streaming import velocity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLICKS = """clicks AS (
  SELECT event_id + 1 AS row_id, user_id::INT AS ip, k % 20 AS app, k % 3 AS device, k % 7 AS os, k AS channel, ts AS click_time,
         CASE WHEN event_type = 'purchase' THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS attributed_time,
         (event_type = 'purchase')::INT AS is_attributed
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""
SCORED = CLICKS + """, scored AS (SELECT row_id AS case_id, click_time, is_attributed AS y_true, is_attributed AS label, p, 1.0::DOUBLE - p AS fraud_score FROM (
  SELECT *, round(((row_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE * is_attributed, 6) AS p FROM clicks))"""
PERIOD = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None, *, ctes: str = CLICKS) -> Callable:
    def wrap(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(from_events(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = f"WITH {ctes}\n{sql}"
        return f

    return wrap


def scored(clicks: DataFrame) -> DataFrame:
    """Deterministic scores with some signal."""
    p = F.round((F.col("row_id") * 7919 % 1000) / 1000.0 * 0.7 + 0.3 * F.col("is_attributed"), 6)
    out = clicks.withColumns({"case_id": F.col("row_id"), "y_true": F.col("is_attributed").cast("int"), "label": F.col("is_attributed").cast("int"), "p": p})
    return out.withColumn("fraud_score", triage.fraud_score("p"))


# Sources and sinks


@register("s1_csv_scan", "SELECT count(*) AS n, sum(ip)::BIGINT AS ips, count(attributed_time) AS n_attributed, max(click_time) AS latest FROM clicks")
def _csv(clicks: DataFrame) -> DataFrame:
    path = shared_path(clicks.sparkSession, "csv")
    form = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    clicks.select("ip", "app", "device", "os", "channel", form("click_time"), form("attributed_time"), "is_attributed").write.option("header", True).csv(path)
    return read_csv(clicks.sparkSession, path).agg(F.count(F.lit(1)).alias("n"), F.sum("ip").alias("ips"), F.count("attributed_time").alias("n_attributed"), F.max("click_time").alias("latest"))


@register("s3_row_id", "SELECT row_number() OVER (ORDER BY click_time, ip, app, device, os, channel) AS row_id, click_time, ip, app FROM clicks")
def _row_id(clicks: DataFrame) -> DataFrame:
    return with_row_id(clicks.drop("row_id")).select("row_id", "click_time", "ip", "app")


@register("s4_parquet_scan", "SELECT row_id, ip::FLOAT AS ip, channel::FLOAT AS channel, is_attributed::TINYINT AS is_attributed FROM clicks")
def _downcast(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", F.col("ip").cast("float").alias("ip"), F.col("channel").cast("float").alias("channel"), F.col("is_attributed").cast("byte").alias("is_attributed"))


@register("s8_store", "SELECT row_id, app AS f1_app_id, extract(hour FROM click_time)::BIGINT AS f1_hour_of_day FROM clicks WHERE click_time < TIMESTAMP '2024-01-19'")
def _store(clicks: DataFrame) -> DataFrame:
    spark = clicks.sparkSession
    store = FeatureStore(spark, shared_path(spark, "store"))
    base = clicks.where(split_predicate("train")).select("row_id", F.col("app").alias("f1_app_id"), F.hour("click_time").cast("long").alias("f1_hour_of_day"))
    store.save(base, "v0.1.0", "train", "events")
    loaded = store.load(store.versions()[-1], "train")
    return loaded.select("row_id", *feature_columns(loaded))


@register("s6_csv_sink", "SELECT is_attributed, count(*) AS n_clicks FROM clicks GROUP BY 1")
def _csv_sink(clicks: DataFrame) -> DataFrame:
    path = shared_path(clicks.sparkSession, "profile")
    write_csv(profile.null_patterns(clicks), path)
    return clicks.sparkSession.read.schema("is_attributed int, n_clicks long, n_null_attributed long, n_nonnull_attributed long").option("header", True).csv(path).select("is_attributed", "n_clicks")


@register("s2_ingest", "SELECT row_number() OVER (ORDER BY click_time, ip, app, device, os, channel) AS row_id, ip, app, device, os, channel, click_time, attributed_time, is_attributed FROM clicks")
def _ingest(clicks: DataFrame) -> DataFrame:
    spark, text, table = clicks.sparkSession, shared_path(clicks.sparkSession, "csv"), shared_path(clicks.sparkSession, "clicks")
    form = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    clicks.select("ip", "app", "device", "os", "channel", form("click_time"), form("attributed_time"), "is_attributed").write.option("header", True).csv(text)
    n = ingest_csv(spark, text, table)
    return spark.read.parquet(table).where(F.col("row_id") <= n).withColumn("is_attributed", F.col("is_attributed").cast("int"))


@register("s7_run_profiles", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, 10 AS n_reports FROM clicks" for c in profile.COLUMNS))
def _run_profiles(clicks: DataFrame) -> DataFrame:
    folder = shared_path(clicks.sparkSession, "profiles")
    names = profile.run_profiles(clicks, folder)
    return clicks.sparkSession.read.schema("column_name string, n_distinct long").option("header", True).csv(f"{folder}/e2_cardinality").withColumn("n_reports", F.lit(len(names)))


def _each_report() -> str:
    """The number of rows of each profile's SQL."""
    inner = {n: f"WITH {q[1:].lstrip()}" if q.startswith(",") else q for n, q in _PROFILE_SQL.items()}
    return " UNION ALL ".join(f"SELECT '{n}' AS report, (SELECT count(*) FROM ({q})) AS n_rows" for n, q in inner.items())


@register("s9_register", "SELECT row_id, app AS f1_app_id, 'v1.0.0' AS version FROM clicks WHERE click_time >= TIMESTAMP '2024-01-19' AND click_time < TIMESTAMP '2024-01-25'")
def _adopt(clicks: DataFrame) -> DataFrame:
    spark, path = clicks.sparkSession, shared_path(clicks.sparkSession, "elsewhere")
    clicks.where(split_predicate("val")).select("row_id", F.col("app").alias("f1_app_id")).write.parquet(path)
    store = FeatureStore(spark, shared_path(spark, "store"))
    store.register(path, "v1.0.0", "val", "elsewhere")
    return store.load("v1.0.0", "val").withColumn("version", F.lit(store.versions()[0]))


# Projections, filters, joins

register("p1_split_predicate", "SELECT row_id FROM clicks WHERE click_time >= TIMESTAMP '2024-01-19' AND click_time < TIMESTAMP '2024-01-25'")(lambda c: c.where(split_predicate("val")).select("row_id"))
register("p2_split_views", "SELECT CASE WHEN click_time < TIMESTAMP '2024-01-19' THEN 'train' WHEN click_time < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows FROM clicks GROUP BY 1")(create_split_views)
register("p3_apply_split", "SELECT row_id, click_time FROM clicks WHERE click_time < TIMESTAMP '2024-01-19'")(lambda c: apply_split(c, "train").select("row_id", "click_time"))
register("fn_json", "SELECT row_id, ip, app, '{\"ip\":' || ip || ',\"app\":' || app || '}' AS encoded FROM clicks")(lambda c: c.select("row_id", F.to_json(F.struct("ip", "app")).alias("encoded")).select("row_id", F.inline(F.array(F.from_json("encoded", "ip int, app int"))), "encoded"))
register("fn_uuid", "SELECT count(*) AS n_ids, 36 AS length FROM clicks")(lambda c: c.select(F.uuid().alias("u")).agg(F.count_distinct("u").alias("n_ids"), F.max(F.length("u")).alias("length")))
register("o4_limit_unordered", "SELECT least(count(*), 250) AS n FROM clicks")(lambda c: c.limit(250).agg(F.count(F.lit(1)).alias("n")))
register("p4_get_splits", "SELECT 'train' AS name, min(click_time) AS start, TIMESTAMP '2024-01-19' AS end_exclusive FROM clicks UNION ALL SELECT 'val', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-25' UNION ALL SELECT 'test', TIMESTAMP '2024-01-25', NULL")(split_ranges)
register("p8_star_exclude", "SELECT * EXCLUDE (row_id, attributed_time) FROM clicks")(lambda c: c.drop("row_id", "attributed_time").withColumn("is_attributed", F.col("is_attributed").cast("int")))
register("p9_id_membership", "SELECT row_id, ip FROM clicks WHERE row_id IN (SELECT row_id FROM clicks WHERE is_attributed = 1 AND channel < 10)")(lambda c: c.select("row_id", "ip").join(c.where("is_attributed = 1 AND channel < 10").select("row_id"), "row_id", "left_semi"))
register("p11_null_fill", "SELECT row_id, coalesce(epoch_us(attributed_time) - epoch_us(click_time), -1)::BIGINT AS lag_us FROM clicks")(lambda c: c.select("row_id", F.coalesce(F.unix_micros(F.col("attributed_time").cast("timestamp")) - F.unix_micros(F.col("click_time").cast("timestamp")), F.lit(-1)).alias("lag_us")))
register("j1_inner_equi", "SELECT a.row_id, a.app, b.ip, c.os FROM clicks a JOIN clicks b USING (row_id) JOIN clicks c USING (row_id)")(lambda c: c.select("row_id", "app").join(c.select("row_id", "ip"), "row_id").join(c.select("row_id", "os"), "row_id"))


@register("j3_asof_backward", "SELECT l.row_id, r.channel AS bought FROM (SELECT row_id, ip, click_time, click_time - INTERVAL '1 millisecond' AS t FROM clicks) l ASOF LEFT JOIN (SELECT ip, click_time, max(channel) AS channel FROM clicks WHERE is_attributed = 1 GROUP BY 1, 2) r ON l.ip = r.ip AND l.t >= r.click_time")
def _asof(clicks: DataFrame) -> DataFrame:
    right = clicks.where("is_attributed = 1").groupBy("ip", "click_time").agg(F.max("channel").alias("bought"))
    return asof_last(clicks.select("row_id", "ip", "click_time"), right, "ip", "click_time", "click_time", "bought", 1000).select("row_id", "bought")


@register("u4_compute_set", "SELECT row_id, n, CASE WHEN n > 50 THEN 1 ELSE 0 END::TINYINT AS busy FROM (SELECT row_id, count(*) OVER (PARTITION BY ip) AS n FROM clicks)")
def _feature_set(clicks: DataFrame) -> DataFrame:
    busy = Feature("busy", lambda df: F.when(F.col("n") > 50, 1).otherwise(0), "tinyint", dependencies=("n",))
    count = Feature("n", "SELECT row_id, count(*) OVER (PARTITION BY ip) AS value FROM {source}", "bigint")
    return FeatureSet([busy, count]).compute(clicks.sparkSession, clicks).select("row_id", "n", "busy")


@register("u3_register", "SELECT row_id, k, CASE WHEN k > 20 THEN 1 ELSE 0 END::TINYINT AS wide FROM (SELECT row_id, count(*) OVER (PARTITION BY app) AS k FROM clicks)")
def _registered(clicks: DataFrame) -> DataFrame:
    registry = Registry()
    registry.register(Feature("k", "SELECT row_id, count(*) OVER (PARTITION BY app) AS value FROM {source}", "bigint"))
    registry.feature("wide", "tinyint", dependencies=("k",))(lambda df: F.when(F.col("k") > 20, 1).otherwise(0))
    return FeatureSet(list(registry.features.values())).compute(clicks.sparkSession, clicks).select("row_id", "k", "wide")


# Aggregations and profiles

register("a2_global", "SELECT count(*) AS n, sum(is_attributed)::BIGINT AS y, round(avg(is_attributed), 6) AS rate, min(click_time) AS first, max(click_time) AS last FROM clicks")(lambda c: c.agg(F.count(F.lit(1)).alias("n"), F.sum("is_attributed").cast("long").alias("y"), F.avg(F.col("is_attributed").cast("double")).alias("rate"), F.min("click_time").alias("first"), F.max("click_time").alias("last")))
register("a1_grouped", "SELECT ip, app, count(*) AS n, round(avg(is_attributed), 6) AS rate, min(channel) AS lo, max(channel) AS hi FROM clicks GROUP BY 1, 2")(lambda c: c.groupBy("ip", "app").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_attributed").cast("double")).alias("rate"), F.min("channel").alias("lo"), F.max("channel").alias("hi")))
register("a4_distinct", "SELECT app, count(DISTINCT ip) AS ips, count(DISTINCT channel) AS channels FROM clicks GROUP BY 1")(lambda c: c.groupBy("app").agg(F.count_distinct("ip").alias("ips"), F.count_distinct("channel").alias("channels")))


def _statistics(value: str, source: str) -> str:
    one = lambda n, e: f"SELECT '{n}' AS stat, round(({e})::DOUBLE, 6) AS value FROM s"
    parts = [one("count", "count(*)"), one("min", f"min({value})"), *[one(n, f"quantile_cont({value}, {q})") for n, q in profile.QUANTILES.items()], one("mean", f"avg({value})"), one("max", f"max({value})")]
    return f", s AS ({source}) " + " UNION ALL ".join(parts)


_AGGS = "count(*) AS n_clicks, {} AS n_attributed, round(avg(is_attributed), 6) AS positive_rate"
_Y = "sum(is_attributed)::BIGINT"
_PROFILE_SQL = {
    "e1_class_balance": " UNION ALL ".join(f"SELECT '{level}' AS level, {day} AS day, {hour} AS hour_of_day, {_AGGS.format(_Y)} FROM clicks {group}" for level, day, hour, group in (("overall", "NULL::VARCHAR", "NULL::INT", ""), ("by_day", "click_time::DATE::VARCHAR", "NULL::INT", "GROUP BY click_time::DATE"), ("by_hour_of_day", "NULL::VARCHAR", "extract(hour FROM click_time)::INT", "GROUP BY extract(hour FROM click_time)"))),
    "e2_cardinality": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM clicks" for c in profile.COLUMNS),
    "e3_top_values": " UNION ALL ".join(f"(SELECT '{c}' AS col, {c}::BIGINT AS value, count(*) AS n_clicks, round(avg(is_attributed), 6) AS positive_rate FROM clicks GROUP BY {c} ORDER BY n_clicks DESC, value LIMIT 20)" for c in profile.COLUMNS),
    "e4_temporal": f"SELECT date_trunc('hour', click_time) AS hour, {_AGGS.format(_Y)} FROM clicks GROUP BY 1",
    "e5_ip_concentration": ", i AS (SELECT ip, count(*) AS n, avg(is_attributed) AS r FROM clicks GROUP BY ip), b AS (SELECT CASE WHEN n = 1 THEN '01: 1' WHEN n <= 10 THEN '02: 2-10' WHEN n <= 100 THEN '03: 11-100' WHEN n <= 1000 THEN '04: 101-1000' ELSE '05: >1000' END AS clicks_bucket, * FROM i) SELECT clicks_bucket, count(*) AS n_ips, sum(n)::BIGINT AS n_clicks_total, round(sum(n) / sum(sum(n)) OVER (), 6) AS fraction_of_all_clicks, round(avg(r), 6) AS mean_ip_positive_rate FROM b GROUP BY 1",
    "e6_ip_app_pairs": ", q AS (SELECT ip, app, count(*) AS n, sum(is_attributed) AS y, avg(is_attributed) AS r FROM clicks GROUP BY 1, 2 HAVING count(*) >= 5) SELECT CASE WHEN r = 0 THEN '01: 0% (never converts)' WHEN r < 0.05 THEN '02: 0-5%' WHEN r < 0.2 THEN '03: 5-20%' WHEN r < 0.5 THEN '04: 20-50%' WHEN r < 1 THEN '05: 50-99%' ELSE '06: 100% (always converts)' END AS positive_rate_bucket, count(*) AS n_pairs, sum(n)::BIGINT AS n_clicks_total, sum(y)::BIGINT AS n_attributed_total FROM q GROUP BY 1",
    "e7_inter_click_time": _statistics("g", "SELECT * FROM (SELECT (epoch_us(click_time) - epoch_us(lag(click_time) OVER (PARTITION BY ip ORDER BY click_time))) / 1e6 AS g FROM clicks) WHERE g IS NOT NULL"),
    "e8_attributed_lag": _statistics("g", "SELECT (epoch_us(attributed_time) - epoch_us(click_time)) / 1e6 AS g FROM clicks WHERE attributed_time IS NOT NULL"),
    "e9_null_patterns": "SELECT is_attributed::TINYINT AS is_attributed, count(*) AS n_clicks, count(*) FILTER (WHERE attributed_time IS NULL) AS n_null_attributed, count(attributed_time) AS n_nonnull_attributed FROM clicks GROUP BY 1",
    "e10_anomalies": ", i AS (SELECT ip::BIGINT AS ip, count(*) AS n_clicks, count(DISTINCT app) AS n_distinct_apps, count(DISTINCT channel) AS n_distinct_channels, round(avg(is_attributed), 6) AS positive_rate FROM clicks GROUP BY 1) (SELECT 'high_click_count' AS bucket, * FROM i WHERE n_clicks > 500 ORDER BY n_clicks DESC, ip LIMIT 50) UNION ALL (SELECT 'high_distinct_apps', * FROM i WHERE n_distinct_apps >= 10 ORDER BY n_distinct_apps DESC, n_clicks DESC, ip LIMIT 50)",
}
@register("s7_reports", _each_report())
def _reports(clicks: DataFrame) -> DataFrame:
    """The rows of each of the ten reports, as written."""
    spark, folder = clicks.sparkSession, shared_path(clicks.sparkSession, "profiles")
    out = None
    for name in profile.run_profiles(clicks, folder):
        one = spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


for _name, _f in profile.PROFILES.items():
    # Dates as text: engines hand them over in different ways.
    register(_name, _PROFILE_SQL[_name])(lambda c, f=_f: (lambda d: d.withColumn("day", F.col("day").cast("string")) if "day" in d.columns else d)(f(c)))


def _sketched(clicks: DataFrame) -> HourlySketches:
    """The clicks' sketches from two updates: the second reads the hours of the second half only."""
    kept = HourlySketches(clicks.sparkSession, shared_path(clicks.sparkSession, "sketches"))
    for upto in ("2024-01-16 00:00:00", "2024-03-01 00:00:00"):
        kept.update(clicks, upto)
    return kept


@register("e2_cardinality_approx", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, true AS within FROM clicks" for c in profile.COLUMNS))
def _cardinality_approx(clicks: DataFrame) -> DataFrame:
    """The exact counts, and whether the sketches' are within three standard errors (and one, for small counts) of them."""
    exact, estimate = F.col("n_exact"), F.col("n_distinct")
    both = profile.cardinality(clicks).withColumnRenamed("n_distinct", "n_exact").join(_sketched(clicks).cardinality(), "column_name")
    return both.select("column_name", "n_exact", (F.abs(exact - estimate) <= 1 + exact * distinct_error(1.0)).alias("within"))


@register("e7_inter_click_time_approx", "SELECT stat, true AS within FROM (VALUES " + ", ".join(f"('{n}')" for n in ("count", "min", *profile.QUANTILES, "mean", "max")) + ") v(stat)")
def _gaps_approx(clicks: DataFrame) -> DataFrame:
    """Whether each statistic of the sketches is within its bound: 2 % of the ranks for quantiles, equal else."""
    gaps = neighbours(sliced(timed(clicks), "ip"), "ip").select(((F.col("__t") - F.col("__before")) / 1e6).alias("g")).where("g IS NOT NULL")
    found = {r["stat"]: r["value"] for r in _sketched(clicks).statistics("gap_seconds").collect()}  # a row a statistic
    ranks = [e for n in profile.QUANTILES for e in (F.count_if(F.col("g") < found[n]).alias(f"{n}_below"), F.count_if(F.col("g") <= found[n]).alias(f"{n}_upto"))]
    one = gaps.agg(F.count("g").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"), F.avg("g").alias("mid"), *ranks)
    share = lambda n, q: (F.col(f"{n}_below") <= (q + 0.02) * F.col("n")) & (F.col(f"{n}_upto") >= (q - 0.02) * F.col("n"))
    tests = {"count": F.col("n") == found["count"], "min": F.col("lo") == found["min"], **{n: share(n, q) for n, q in profile.QUANTILES.items()}, "mean": F.abs(F.col("mid") - found["mean"]) <= 1e-6 * F.abs(F.col("mid")), "max": F.col("hi") == found["max"]}
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), t.alias("within")) for n, t in tests.items()])))


@register("v1_validate", f""", o AS (SELECT count(*) AS n, min(click_time) AS lo, max(click_time) AS hi, avg(is_attributed) AS m, count(*) FILTER (WHERE is_attributed NOT IN (0, 1)) AS bad,
  {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS n_{c}' for c in quality.REQUIRED if c != 'row_id')} FROM clicks)
SELECT 'row_count' AS name, n > 0 AS ok FROM o {' '.join(f"UNION ALL SELECT 'not_null_{c}', n_{c} = 0 FROM o" for c in quality.REQUIRED if c != 'row_id')}
UNION ALL SELECT 'label_values', bad = 0 FROM o UNION ALL SELECT 'time_range', lo >= TIMESTAMP '{PERIOD[0]}' AND hi < TIMESTAMP '{PERIOD[1]}' FROM o UNION ALL SELECT 'class_balance', m BETWEEN 0.1 AND 0.3 FROM o""")
def _validate(clicks: DataFrame) -> DataFrame:
    return quality.validate(clicks, (0.1, 0.3), PERIOD).select("name", "ok")


@register("v2_fetch_one", "SELECT count(*) AS n, min(click_time) AS first FROM clicks")
def _one(clicks: DataFrame) -> DataFrame:
    found = clicks.agg(F.count(F.lit(1)).alias("n"), F.min("click_time").alias("first"))
    return clicks.sparkSession.createDataFrame([quality.exactly_one(found)], found.schema)


# The 28 features

_R = {"1hr": "RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MILLISECOND PRECEDING", "24hr": "RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MILLISECOND PRECEDING", "alltime": "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MILLISECOND PRECEDING"}


def _over(expression: str, keys: str, span: str) -> str:
    return f"{expression} OVER (PARTITION BY {keys} ORDER BY click_time {_R[span]})"


_GAP = "date_diff('second', lag(click_time) OVER (PARTITION BY ip ORDER BY click_time, row_id), click_time)"
FEATURE_SQL: dict[str, str] = {
    "f1_app_id": "app", "f1_channel_id": "channel", "f1_device_id": "device", "f1_os_id": "os",
    "f1_hour_of_day": "extract(hour FROM click_time)::BIGINT", "f1_day_of_week": "isodow(click_time)::BIGINT",
    "f1_ip_app_interaction": "ip || '_' || app", "f1_ip_device_interaction": "ip || '_' || device",
    "f2_clicks_per_ip_last_1hr": _over("count(*)", "ip", "1hr"), "f2_clicks_per_ip_last_24hr": _over("count(*)", "ip", "24hr"),
    "f2_clicks_per_ip_app_last_1hr": _over("count(*)", "ip, app", "1hr"), "f2_inter_click_time_seconds": _GAP,
    **{f"f3_{n}_conversion_rate_{s}": f"round({_over('avg(is_attributed)', k, s)}, 6)" for n, k in (("ip", "ip"), ("app", "app"), ("ip_app", "ip, app")) for s in ("24hr", "alltime")},
    **{f"f3_{n}_clicks_alltime": _over("count(*)", k, "alltime") for n, k in (("ip", "ip"), ("app", "app"), ("ip_app", "ip, app"))},
    "f3_ip_app_clicks_24hr": _over("count(*)", "ip, app", "24hr"),
    **{f"f3_ip_distinct_{n}_24hr": _over(f"count(DISTINCT {c})", "ip", "24hr") for n, c in (("apps", "app"), ("devices", "device"), ("oses", "os"))},
    "f3_app_distinct_ips_24hr": _over("count(DISTINCT ip)", "app", "24hr"),
}
_WITH_GAP = f", g AS (SELECT *, {_GAP} AS gap, {_over('count(*)', 'ip', '1hr')} AS n1 FROM clicks)"
_STD = _over("stddev_samp(gap)", "ip", "24hr")
_BURST = "CASE WHEN n1 > 10 AND gap < 60 THEN 1 ELSE 0 END::TINYINT"
for _name in FEATURES:
    if _name == "f2_ip_click_std_inter_arrival":
        _sql = f"{_WITH_GAP} SELECT row_id, round({_STD}, 6) AS {_name} FROM g"
    elif _name == "f2_burst_score":
        _sql = f"{_WITH_GAP} SELECT row_id, {_BURST} AS {_name} FROM g"
    else:
        _sql = f"SELECT row_id, {FEATURE_SQL[_name]} AS {_name} FROM clicks"
    register(_name, _sql)(lambda c, n=_name: feature(c, n))

_ALL = ", ".join(f"{_STD if n == 'f2_ip_click_std_inter_arrival' else _BURST if n == 'f2_burst_score' else FEATURE_SQL[n]} AS {n}" if n != "f2_ip_click_std_inter_arrival" else f"round({_STD}, 6) AS {n}" for n in FEATURES)


@register("u5_materialize", f"{_WITH_GAP}, f AS (SELECT row_id, click_time, {_ALL} FROM g) SELECT * EXCLUDE (click_time) FROM f WHERE click_time >= TIMESTAMP '2024-01-19' AND click_time < TIMESTAMP '2024-01-25'")
def _materialize(clicks: DataFrame) -> DataFrame:
    return materialize.feature_table(clicks, "val").select("row_id", *FEATURES)


@register("u6_resumable_pass", f"{_WITH_GAP}, f AS (SELECT row_id, click_time, {_ALL} FROM g) SELECT * EXCLUDE (click_time), 1 AS passes_before, {len(PASSES) - 1} AS passes_after FROM f WHERE click_time < TIMESTAMP '2024-01-25'")
def _resumed(clicks: DataFrame) -> DataFrame:
    """A build that stops after its first pass, then train and val of the same input: the second build goes on, the third finds all passes."""
    spark, root = clicks.sparkSession, shared_path(clicks.sparkSession, "store")
    store, version = FeatureStore(spark, root), materialize.input_version(clicks)
    first = materialize.KeptPasses(spark, f"{root}/passes", version)
    first.keep("edges", lambda: PASSES["edges"](clicks, SLICE_ROWS))
    then = materialize.KeptPasses(spark, f"{root}/passes", version)
    materialize.feature_table(clicks, "train", kept=then)
    for split in ("train", "val"):
        materialize.materialize_features(clicks, store, "v0.1.0", split, "events", made_from=version)
    both = store.load("v0.1.0", "train").unionByName(store.load("v0.1.0", "val"))
    return both.select("row_id", *FEATURES).withColumns({"passes_before": F.lit(first.made), "passes_after": F.lit(then.made)})


register("w8_sessionize", ", m AS (SELECT *, CASE WHEN epoch_us(click_time) - epoch_us(lag(click_time) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS new FROM clicks WINDOW w AS (PARTITION BY ip ORDER BY click_time, row_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY ip ORDER BY click_time, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM m) SELECT ip, segment, min(click_time) AS first, max(click_time) AS last, count(*) AS n_clicks FROM s GROUP BY 1, 2")(lambda c: sessionize(c, "ip"))
register("w9_presence_count", f"SELECT row_id, {_over('count(DISTINCT channel)', 'ip', '24hr')} AS channels FROM clicks")(lambda c: presence_counts(c, "ip", {"channels": "channel"}).select("row_id", "channels"))
register("w10_prefix_diff", f"SELECT row_id, {_over('count(*)', 'app', '24hr')} AS day_n, coalesce({_over('sum(is_attributed)', 'app', '24hr')}, 0)::BIGINT AS day_sum FROM clicks")(lambda c: sliced_prior(c, "app", F.col("is_attributed"), {"day": DAY}).select("row_id", "day_n", "day_sum"))

# Samples

_DRAW = "CAST('0x' || substr(md5({}::VARCHAR || '42'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496"
register("m1_stratified_sample", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY date_trunc('hour', click_time) ORDER BY md5(row_id::VARCHAR), row_id) AS a, count(*) OVER (PARTITION BY date_trunc('hour', click_time)) AS n FROM clicks) WHERE a <= ceil(n * 0.1::DOUBLE)")(lambda c: sampling.stratified_sample(c, 0.1).select("row_id"))
register("m3_fraction_sample", f"SELECT row_id FROM clicks WHERE {_DRAW.format('row_id')} < 0.25")(lambda c: sampling.fraction_sample(c, 0.25).select("row_id"))
register("m4_holdout_split", f"SELECT row_id, {_DRAW.format('row_id')} >= 0.5 AS held_out FROM clicks")(lambda c: (lambda a, b: a.select("row_id", F.lit(False).alias("held_out")).unionByName(b.select("row_id", F.lit(True).alias("held_out"))))(*sampling.holdout_split(c)))
register("m5_rng_draw", f"SELECT row_id, round({_DRAW.format('row_id')}, 6) AS u FROM clicks")(lambda c: c.select("row_id", sampling.draw("row_id", 42).alias("u")))

# Metrics

_CUM = ", d AS (SELECT p, sum(y_true) AS pos, count(*) AS n FROM scored GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS al, sum(pos) OVER () AS tpos, sum(n) OVER () AS tn FROM d)"
_AP, _AUC = "sum(pos * tp / al) / max(tpos)", "sum((n - pos) * (tp - pos / 2.0)) / (max(tpos) * (max(tn) - max(tpos)))"


def on_scores(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql, ctes=SCORED)(lambda c: f(scored(c)))


on_scores("k1_average_precision", f"{_CUM} SELECT round({_AP}, 6) AS pr_auc FROM c", metrics.average_precision)
on_scores("k2_roc_auc", f"{_CUM} SELECT round({_AUC}, 6) AS roc_auc FROM c", metrics.roc_auc)
on_scores("k3_brier", "SELECT round(avg((p - y_true) * (p - y_true)), 6) AS brier FROM scored", metrics.brier)
on_scores("k4_pr_curve", f"{_CUM}, a AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS \"at\", count(*) OVER () AS total FROM c), w AS (SELECT DISTINCT CASE WHEN t.total < 2000 THEN i ELSE i * t.total // 1999 END AS \"at\" FROM range(2000) r(i), (SELECT count(*) AS total FROM c) t) SELECT \"at\", p AS threshold, round(tp / al, 6) AS precision, round(tp / tpos, 6) AS recall FROM a WHERE \"at\" IN (SELECT \"at\" FROM w) UNION ALL SELECT count(*), NULL, 1.0, 0.0 FROM c", metrics.pr_curve)
_BINS = """, l AS (SELECT list(p ORDER BY p) AS s FROM scored), b AS (SELECT s, len(s) AS n, least(10, greatest(2, len(s) // 10)) AS bins FROM l),
e AS (SELECT list_transform(range(1, bins), lambda i: s[((n - 1) * i // bins + 1)::BIGINT] + (s[least((n - 1) * i // bins + 2, n)::BIGINT] - s[((n - 1) * i // bins + 1)::BIGINT]) * ((n - 1) * i % bins / bins::DOUBLE)) AS q FROM b)
SELECT len([x FOR x IN q IF x < p])::INT AS bin, round(avg(p), 6) AS mean_score, round(avg(y_true), 6) AS positive_fraction, count(*) AS n FROM scored, e GROUP BY 1"""
on_scores("k5_calibration_curve", _BINS, metrics.calibration_curve)
on_scores("k6_confusion", ", t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), m AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y_true = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y_true = 0) AS fp, count(*) FILTER (WHERE p < threshold AND y_true = 0) AS tn, count(*) FILTER (WHERE p < threshold AND y_true = 1) AS fn FROM scored, t GROUP BY 1) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM m", metrics.confusion)
_SCALARS = "SELECT '{}' AS name, (SELECT count(*) FROM scored) AS n, (SELECT sum(y_true)::BIGINT FROM scored) AS n_positive, round({}, 6) AS pr_auc, round({}, 6) AS roc_auc, (SELECT round(avg((p - y_true) * (p - y_true)), 6) FROM scored) AS brier FROM c"
on_scores("k7_evaluate", f"{_CUM} {_SCALARS.format('fixed', _AP, _AUC)}", lambda s: metrics.scalars(s, "fixed"))
on_scores("k8_compare", f"{_CUM} {_SCALARS.format('a', _AP, _AUC)} UNION ALL {_SCALARS.format('b', _AP, _AUC)}", lambda s: metrics.compare([metrics.scalars(s, "b"), metrics.scalars(s, "a")]))

def _bundle(s: DataFrame) -> DataFrame:
    """The confusion table of the bundle, read back from its JSON."""
    spark, path = s.sparkSession, shared_path(s.sparkSession, "metrics")
    metrics.save_json(metrics.evaluate(s, "fixed"), spark, path)
    kind = "confusion array<struct<threshold:double,tp:long,fp:long,tn:long,fn:long,precision:double,recall:double>>, pr_auc double"
    return spark.read.text(path).select(F.from_json("value", kind).alias("b")).select(F.inline("b.confusion"), F.col("b.pr_auc").alias("pr_auc"))


_K6 = ORACLES["k6_confusion"].removeprefix(f"WITH {SCORED}\n")
on_scores("s14_metrics_sink", f"{_CUM}{_K6.replace('SELECT *, round(CASE', 'SELECT *, (SELECT round(' + _AP + ', 6) FROM c) AS pr_auc, round(CASE', 1)}", _bundle)

# Costs, sweep, routing


def _policy(block: float, review: float) -> str:
    f = "fraud_score"
    return f"SELECT *, round(fp_cost + fn_cost + review_cost, 6) AS total_cost, round((fp_cost + fn_cost + review_cost) / (n_blocked + n_reviewed + n_allowed), 6) AS cost_per_click FROM (SELECT *, round(false_positives * 0.3::DOUBLE, 6) AS fp_cost, round(false_negatives * 0.3::DOUBLE, 6) AS fn_cost, round(n_reviewed * 0.5::DOUBLE, 6) AS review_cost FROM (SELECT count(*) FILTER (WHERE {f} >= {block}) AS n_blocked, count(*) FILTER (WHERE {f} >= {review} AND {f} < {block}) AS n_reviewed, count(*) FILTER (WHERE {f} < {review}) AS n_allowed, count(*) FILTER (WHERE {f} >= {block} AND label = 1) AS false_positives, count(*) FILTER (WHERE {f} < {review} AND label = 0) AS false_negatives FROM scored))"


_GRID = ", g AS (SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in triage.GRID) + "]) AS t), h AS (SELECT t, count(*) FILTER (WHERE fraud_score >= t AND label = 1) AS l, count(*) FILTER (WHERE fraud_score >= t AND label = 0) AS f, count(*) FILTER (WHERE label = 1) AS al, count(*) FILTER (WHERE label = 0) AS af FROM scored, g GROUP BY t), pr AS (SELECT b.t AS t_block, r.t AS t_review, b.l AS fp, b.af - r.f AS fn, r.l + r.f - b.l - b.f AS rv, b.al + b.af AS n FROM h b JOIN h r ON r.t <= b.t)"
_COST = "fp * 0.3::DOUBLE + fn * 0.3::DOUBLE + rv * 0.5::DOUBLE"
_SURFACE = f"SELECT t_block, t_review, round({_COST}, 6) AS total_cost, rv AS n_reviewed, round(rv / n, 6) AS review_fraction FROM pr"
_BEST = " ORDER BY total_cost, t_block, t_review LIMIT 1"
on_scores("t1_fraud_score", "SELECT case_id, round(fraud_score, 6) AS fraud_score FROM scored", lambda s: s.select("case_id", "fraud_score"))
on_scores("t2_expected_cost", _policy(0.7, 0.5), lambda s: triage.expected_cost(s, 0.7, 0.5))
on_scores("t3_sweep", f"{_GRID} {_SURFACE}", triage.sweep)
on_scores("t4_best", f"{_GRID} {_SURFACE}{_BEST}", lambda s: triage.best(triage.sweep(s)))
on_scores("t5_best_capped", f"{_GRID} {_SURFACE} WHERE rv / n <= 0.02{_BEST}", lambda s: triage.best_capped(triage.sweep(s), 0.02))
on_scores("t6_allow_all", _policy(2.0, 2.0), triage.allow_all)
_SCENARIOS = ", sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c.block_legitimate!r}::DOUBLE, {c.allow_fraud!r}::DOUBLE, {c.review!r}::DOUBLE)" for n, c in triage.scenarios().items()) + ") v(scenario, cb, ca, cr))"
on_scores("t7_sensitivity", f"{_GRID}{_SCENARIOS} SELECT scenario, t_block, t_review, round(total, 6) AS total_cost, round(rv / n, 6) AS review_fraction FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(total, 6), t_block, t_review) AS a FROM (SELECT *, fp * cb + fn * ca + rv * cr AS total FROM pr, sc)) WHERE a = 1", triage.sensitivity)
_ACTION = f"CASE WHEN fraud_score >= 0.8 THEN 'AUTO_BLOCK' WHEN fraud_score >= 0.6 THEN 'HUMAN_REVIEW' WHEN {_DRAW.format('case_id')} < 0.05 THEN 'QA_SAMPLE' ELSE 'ALLOW' END"
on_scores("r2_route", f"SELECT case_id, {_ACTION} AS action FROM scored", lambda s: triage.route(s, 0.8, 0.6, 0.05).select("case_id", "action"))
on_scores("r4_quantile_thresholds", "SELECT round(quantile_cont(fraud_score, 0.995), 6) AS t_block, round(quantile_cont(fraud_score, 0.975), 6) AS t_review FROM scored", triage.quantile_thresholds)
on_scores("r5_two_way", "SELECT case_id, CASE WHEN p > 0.5 THEN 'AUTO_BLOCK' ELSE 'ALLOW' END AS action FROM scored", lambda s: s.select("case_id", triage.two_way("p").alias("action")))
on_scores("d4_action_mix", f"SELECT {_ACTION} AS action, count(*) AS n FROM scored GROUP BY 1", lambda s: triage.action_mix(triage.route(s, 0.8, 0.6, 0.05)))


def _logged(s: DataFrame) -> DataFrame:
    path = shared_path(s.sparkSession, "audit")
    routed = triage.route(s.withColumns({"raw_score": F.col("p"), "calibrated_score": F.col("p")}), 0.8, 0.6, 0.05)
    audit.append(audit.rows(routed, "fixed", "cost-v1", 0.8, 0.6), path)
    return audit.read(s.sparkSession, path)


on_scores("s13_audit_append", f"SELECT action, count(*) AS n, round(sum(p), 4) AS scores FROM (SELECT *, {_ACTION} AS action FROM scored) WHERE action <> 'ALLOW' GROUP BY 1", lambda s: _logged(s).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("raw_score"), 4).alias("scores")))
on_scores("d3_review_queue", f"SELECT case_id::VARCHAR AS case_id, p AS calibrated_score FROM (SELECT *, {_ACTION} AS action FROM scored) WHERE action = 'HUMAN_REVIEW' ORDER BY p, case_id::VARCHAR LIMIT 500", lambda s: audit.review_queue(_logged(s)).select("case_id", "calibrated_score"))

# Models: judged by metrics, without SQL

register("l1_random_score", f"SELECT row_id, round({_DRAW.format('row_id')}, 6) AS p FROM clicks")(lambda c: models.score_random(c).select("row_id", "p"))
register("l4_class_weight", "SELECT is_attributed::DOUBLE AS label, count(*) AS n, round((SELECT count(*) FROM clicks) / (2.0 * count(*)), 6) AS weight FROM clicks GROUP BY 1")(lambda c: models.weighted(models.filled(c, [])).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))
register("l2_pair_rate_score", f", r AS (SELECT *, {_over('avg(is_attributed)', 'ip, app', '24hr')} AS f FROM clicks) SELECT row_id, round(coalesce(f, (SELECT avg(is_attributed) FROM clicks WHERE click_time < TIMESTAMP '2024-01-19')), 6) AS p FROM r WHERE click_time >= TIMESTAMP '2024-01-19' AND click_time < TIMESTAMP '2024-01-25'")(
    lambda c: models.score_pair_rate(c.where(split_predicate("train")), timed(c).withColumn("f", prior_rate(F.col("is_attributed"), ["ip", "app"], DAY)).where(split_predicate("val")), "f").select("row_id", "p")
)


def _parts(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    table = write_once(materialize.feature_table(clicks), "features")
    return table.where(split_predicate("train")), table.where(split_predicate("val"))


def _trees(clicks: DataFrame) -> tuple[DataFrame, DataFrame, PipelineModel]:
    train, val = _parts(clicks)
    return train, val, models.fit_trees(train, val)[0]


@register("l3_logreg")
def _logreg(clicks: DataFrame) -> DataFrame:
    train, val = _parts(clicks)
    return metrics.scalars(models.predict(models.fit_logreg(train), val, models.F1F2), "logreg")


@register("l5_boosted_trees")
def _boosted(clicks: DataFrame) -> DataFrame:
    _, val, model = _trees(clicks)
    return metrics.scalars(models.predict(model, val, NUMERIC), "trees").withColumn("rounds", F.lit(len(model.stages[-1].treeWeights)))


@register("l6_tune")
def _tuned(clicks: DataFrame) -> DataFrame:
    train, val = _parts(clicks)
    return models.halving_search(train, val, shared_path(clicks.sparkSession, "trials"), rounds=10)


@register("l7_ablation")
def _ablated(clicks: DataFrame) -> DataFrame:
    return models.ablation(*_parts(clicks))


@register("l8_importance")
def _important(clicks: DataFrame) -> DataFrame:
    return models.importance(_trees(clicks)[2], NUMERIC)


_VAL = "click_time >= TIMESTAMP '2024-01-19' AND click_time < TIMESTAMP '2024-01-25'"


@register("l9_score", f"SELECT row_id, is_attributed AS y_true, true AS scored, true AS same_again FROM clicks WHERE {_VAL}")
def _scored_rows(clicks: DataFrame) -> DataFrame:
    """Every row of val once, scored by the saved and reloaded bundle as by the model."""
    _, val, model = _trees(clicks)
    path = shared_path(clicks.sparkSession, "bundle")
    models.save_bundle(model, NUMERIC, path)
    again, names = models.load_bundle(path)
    out = models.predict(again, models.predict(model, val, NUMERIC).select(*val.columns, F.col("p").alias("first")), names)
    return out.select("row_id", "y_true", F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("scored"), (F.abs(F.col("p") - F.col("first")) < 1e-12).alias("same_again"))


@register("k9_final_report")
def _final(clicks: DataFrame) -> DataFrame:
    """Model and calibrator from train and val, reported on test."""
    table = write_once(materialize.feature_table(clicks), "features")
    train, val, test = (table.where(split_predicate(s)) for s in ("train", "val", "test"))
    model = models.fit_trees(train, val)[0]
    scored_val, scored_test = (write_once(models.predict(model, part, NUMERIC).select("row_id", "p", "y_true"), "scored") for part in (val, test))
    return models.final_report(scored_val, scored_test, models.isotonic_knots(scored_val))


@register("l10_linear_contributions")
def _linear(clicks: DataFrame) -> DataFrame:
    train, val = _parts(clicks)
    return models.linear_contributions(models.fit_logreg(train), val).select("row_id", "p", "top_features")


@register("l11_tree_contributions")
def _occlusion(clicks: DataFrame) -> DataFrame:
    _, val, model = _trees(clicks)
    routed = models.predict(model, val, NUMERIC).where("p < 0.4").select(*val.columns)
    return models.tree_contributions(model, routed).select("row_id", "top_features")


_KNOTS = ((0.1, 0.0), (0.45, 0.35), (0.6, 0.35), (0.95, 1.0))
on_scores("c2_isotonic_apply", "SELECT case_id, round(CASE WHEN p <= 0.1 THEN 0.0 WHEN p <= 0.45 THEN (p - 0.1::DOUBLE) / (0.45::DOUBLE - 0.1::DOUBLE) * 0.35::DOUBLE WHEN p <= 0.6 THEN 0.35 WHEN p <= 0.95 THEN 0.35::DOUBLE + (p - 0.6::DOUBLE) / (0.95::DOUBLE - 0.6::DOUBLE) * 0.65::DOUBLE ELSE 1.0 END, 6) AS c FROM scored", lambda s: s.select("case_id", models.apply_knots(F.col("p"), list(_KNOTS)).alias("c")))
#: Isotonic regression by its max-min formula: the largest, over starts, of the least mean, over ends, of the scores between.
_PAV = """, d AS (SELECT p, sum(y_true)::DOUBLE AS y, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY p) AS i FROM scored GROUP BY p), u AS (SELECT i, p, sum(y) OVER (ORDER BY i) AS sy, sum(n) OVER (ORDER BY i) AS sn, y, n FROM d),
m AS (SELECT a.i AS a, b.i AS b, (b.sy - a.sy + a.y) / (b.sn - a.sn + a.n) AS v FROM u a JOIN u b ON a.i <= b.i), l AS (SELECT a, b AS i, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m), f AS (SELECT i, max(v) AS v FROM l GROUP BY i)
SELECT p, round(v, 6) AS c FROM f JOIN u USING (i)"""
on_scores("c1_isotonic_fit", _PAV, lambda s: models.with_calibrated(s.select("p").distinct(), models.isotonic_knots(s), "c"))


def _kept_knots(s: DataFrame) -> DataFrame:
    path = shared_path(s.sparkSession, "knots")
    models.save_knots(models.isotonic_knots(s), path)
    return models.with_calibrated(s.select("p").distinct(), models.read_knots(path), "c").select("p", "c")


on_scores("c3_knots_io", _PAV, _kept_knots)


def _scalars(name: str, rows: str) -> str:
    """The scalars of the rows, as a query of its own."""
    return f"""(WITH d AS (SELECT p, sum(y_true) AS pos, count(*) AS n FROM {rows} GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS al, sum(pos) OVER () AS tpos, sum(n) OVER () AS tn FROM d)
SELECT '{name}' AS name, (SELECT count(*) FROM {rows}) AS n, (SELECT sum(y_true)::BIGINT FROM {rows}) AS n_positive, round({_AP}, 6) AS pr_auc, round({_AUC}, 6) AS roc_auc, (SELECT round(avg((p - y_true) * (p - y_true)), 6) FROM {rows}) AS brier FROM c)"""


_HALVES = f", fit AS (SELECT * FROM scored WHERE {_DRAW.format('case_id')} < 0.5), held AS (SELECT * FROM scored WHERE {_DRAW.format('case_id')} >= 0.5)"
_LINE = """, k AS (SELECT p AS x, c AS y FROM pav), b AS (SELECT h.p, h.y_true, lo.x AS x0, lo.y AS y0 FROM held h ASOF LEFT JOIN k lo ON h.p >= lo.x), e AS (SELECT b.*, hi.x AS x1, hi.y AS y1 FROM b ASOF LEFT JOIN k hi ON b.p < hi.x),
calibrated AS (SELECT CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * ((p - x0) / (x1 - x0)) END AS p, y_true FROM e)"""
_PAV_FIT = _PAV.replace("FROM scored", "FROM fit").replace("SELECT p, round(v, 6) AS c FROM f JOIN u USING (i)", ", pav AS (SELECT p, v AS c FROM f JOIN u USING (i))")
on_scores("c1_calibration", f"{_HALVES}{_PAV_FIT}{_LINE} {_scalars('raw', 'held')} UNION ALL {_scalars('calibrated', 'calibrated')}", lambda s: models.calibration_report(s.select("row_id", "p", "y_true")))

# Streams


def stream(name: str, sql: str | None = None) -> Callable:
    def wrap(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {CLICKS}\n{sql}"
        return f

    return wrap


@stream("x1_stream_velocity", "SELECT ip, date_trunc('hour', click_time) AS start, count(*) AS n_clicks FROM clicks GROUP BY 1, 2")
def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = velocity.windowed_counts(velocity.click_stream(spark, sf_dir, closing=True))
    return velocity.run_to_table(spark, counts, "velocity").withColumn("start", F.col("start").cast("timestamp_ntz"))


@stream("x4_stream_sessions", ", m AS (SELECT *, CASE WHEN epoch_us(click_time) - epoch_us(lag(click_time) OVER w) < 86400000000 THEN 0 ELSE 1 END AS new FROM clicks WINDOW w AS (PARTITION BY ip ORDER BY click_time, row_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY ip ORDER BY click_time, row_id ROWS UNBOUNDED PRECEDING) AS segment FROM m) SELECT ip, min(click_time) AS start, max(click_time) + INTERVAL 1 DAY AS \"end\", count(*) AS n_clicks FROM s GROUP BY ip, segment")
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = velocity.run_to_table(spark, velocity.sessions(velocity.click_stream(spark, sf_dir, closing=True)), "sessions")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@stream("x2_stream_prior_features", f"SELECT row_id, ip, {_over('count(*)', 'ip', '24hr')} AS clicks_before, round({_over('avg(is_attributed)', 'ip', '24hr')}, 6) AS rate_before FROM clicks")
def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.run_to_table(spark, velocity.prior_features(velocity.click_stream(spark, sf_dir)), "prior", rocksdb=True)


@stream("x3_stream_route", f"SELECT action, count(*) AS n FROM (SELECT {_ACTION.replace('fraud_score', 's')} AS action FROM (SELECT row_id AS case_id, 1.0::DOUBLE - ((row_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE AS s FROM clicks)) WHERE action <> 'ALLOW' GROUP BY 1")
def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = velocity.click_stream(spark, sf_dir).select(F.col("row_id").alias("case_id"), "click_time", (F.col("row_id") * 7919 % 1000 / 1000.0).alias("p"))
    path = shared_path(spark, "stream-audit")
    velocity.stream_route(spark, clicks, path, 0.8, 0.6, 0.05).awaitTermination()
    return triage.action_mix(audit.read(spark, path))


@stream("x5_stream_late", """, mark AS (SELECT max(click_time) - INTERVAL 1 DAY AS mark FROM clicks WHERE row_id % 10 <> 0),
c AS (SELECT ip, date_trunc('hour', click_time) AS start, row_id % 20 = 10 AND date_trunc('hour', click_time) + INTERVAL 1 HOUR <= mark AS late FROM clicks, mark)
SELECT ip, start, count(*) FILTER (WHERE NOT late) AS n_clicks, count(*) FILTER (WHERE late) AS n_late FROM c GROUP BY 1, 2""")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth click comes after all others, in two batches; the first of them still meets open windows, the second is too late for most."""
    clicks = velocity.with_closing(velocity.stream_clicks(spark, sf_dir))
    path = shared_path(spark, "clicks-late")
    turn = F.when(F.col("row_id") % 10 != 0, 0).when(F.col("row_id") % 20 == 0, 1).otherwise(2)
    files = velocity.write_turns(clicks, turn, 3, path)
    arriving = lambda: velocity.file_stream(spark, path, clicks.schema, files)
    counted = velocity.run_to_table(spark, velocity.windowed_counts(arriving()), "velocity", rocksdb=True)
    late = velocity.late_clicks(spark, arriving(), "late").groupBy("ip", F.date_trunc("hour", "click_time").alias("start")).agg(F.count(F.lit(1)).alias("n_late"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counted.join(late, ["ip", "start"], "full").select("ip", F.col("start").cast("timestamp_ntz").alias("start"), zero("n_clicks"), zero("n_late"))
