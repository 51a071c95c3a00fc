"""Profile queries over clicks, E1 to E10, each one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_once
from .quantiles import exact_quantiles
from .windows import neighbours, sliced, timed

COLUMNS = ("ip", "app", "device", "os", "channel")


def _n() -> Column:
    return F.count(F.lit(1))


def _rate() -> Column:
    return F.avg(F.col("is_attributed").cast("double"))


def class_balance(clicks: DataFrame) -> DataFrame:
    """Overall, by day and by hour of day, from one scan."""
    base = clicks.select("is_attributed", F.to_date("click_time").alias("day"), F.hour("click_time").alias("hour_of_day"))
    sets = base.groupingSets([[], ["day"], ["hour_of_day"]], "day", "hour_of_day")
    out = sets.agg(F.grouping_id().alias("g"), _n().alias("n_clicks"), F.sum("is_attributed").cast("long").alias("n_attributed"), _rate().alias("positive_rate"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "by_day").otherwise("by_hour_of_day")
    # Grouping sets over an empty table give no overall row; no clicks, no balance.
    return out.select(level.alias("level"), "day", "hour_of_day", "n_clicks", "n_attributed", "positive_rate").orderBy("level", F.asc_nulls_first("day"), F.asc_nulls_first("hour_of_day"))


def cardinality(clicks: DataFrame) -> DataFrame:
    one = clicks.agg(*[F.count_distinct(c).alias(c) for c in COLUMNS])
    return one.unpivot([], list(COLUMNS), "column_name", "n_distinct")


def top_values(clicks: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    long = clicks.select("is_attributed", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("long").alias("value")) for c in COLUMNS])))
    counted = long.groupBy("col", "value").agg(_n().alias("n_clicks"), _rate().alias("positive_rate"))
    w = Window.partitionBy("col").orderBy(F.desc("n_clicks"), "value")
    return counted.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).drop("at").orderBy("col", F.desc("n_clicks"), "value")


def temporal(clicks: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "click_time").cast("timestamp_ntz")
    return clicks.groupBy(hour.alias("hour")).agg(_n().alias("n_clicks"), F.sum("is_attributed").cast("long").alias("n_attributed"), _rate().alias("positive_rate")).orderBy("hour")


def band(value: Column, bands: list[tuple[Column, str]], rest: str) -> Column:
    """The first band whose condition holds."""
    out = F.lit(rest)
    for condition, label in reversed(bands):
        out = F.when(condition, label).otherwise(out)
    return out


#: Band labels are fixed values of the report.
def count_band(n: Column) -> Column:
    return band(n, [(n == 1, "01: 1"), (n.between(2, 10), "02: 2-10"), (n.between(11, 100), "03: 11-100"), (n.between(101, 1000), "04: 101-1000")], "05: >1000")


def rate_band(r: Column) -> Column:
    return band(r, [(r == 0.0, "01: 0% (never converts)"), (r < 0.05, "02: 0-5%"), (r < 0.20, "03: 5-20%"), (r < 0.50, "04: 20-50%"), (r < 1.0, "05: 50-99%")], "06: 100% (always converts)")


def ip_concentration(clicks: DataFrame) -> DataFrame:
    ips = clicks.groupBy("ip").agg(_n().alias("n"), _rate().alias("rate"))
    out = ips.groupBy(count_band(F.col("n")).alias("clicks_bucket")).agg(_n().alias("n_ips"), F.sum("n").alias("n_clicks_total"), F.avg("rate").alias("mean_ip_positive_rate"))
    share = F.col("n_clicks_total") / F.sum("n_clicks_total").over(Window.partitionBy())  # five rows
    return out.select("clicks_bucket", "n_ips", "n_clicks_total", share.alias("fraction_of_all_clicks"), "mean_ip_positive_rate").orderBy("clicks_bucket")


def ip_app_pairs(clicks: DataFrame, least: int = 5) -> DataFrame:
    pairs = clicks.groupBy("ip", "app").agg(_n().alias("n"), F.sum("is_attributed").alias("y"), _rate().alias("rate")).where(F.col("n") >= least)
    return pairs.groupBy(rate_band(F.col("rate")).alias("positive_rate_bucket")).agg(_n().alias("n_pairs"), F.sum("n").alias("n_clicks_total"), F.sum("y").cast("long").alias("n_attributed_total")).orderBy("positive_rate_bucket")


QUANTILES = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def statistics(values: DataFrame, value: str) -> DataFrame:
    """(stat, value): count, min, interpolated quantiles, mean, max of the non-null values, which are evaluated once."""
    known = write_once(values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value)), "values")
    x = F.col(value)
    one = known.agg(_n().cast("double").alias("count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))
    found = exact_quantiles(known, value, list(QUANTILES.values()))
    wide = one.select("count", "min", *[F.lit(v).cast("double").alias(n) for n, v in zip(QUANTILES, found, strict=True)], "mean", "max")
    return wide.unpivot([], wide.columns, "stat", "value")


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    us = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (us(later) - us(earlier)) / 1e6


def inter_click_time(clicks: DataFrame) -> DataFrame:
    """Gaps between an ip's clicks; an ip with many clicks is cut into time slices."""
    out = neighbours(sliced(timed(clicks), "ip"), "ip")
    return statistics(out.select(((F.col("__t") - F.col("__before")) / 1e6).alias("gap_seconds")), "gap_seconds")


def attributed_lag(clicks: DataFrame) -> DataFrame:
    bought = clicks.where((F.col("is_attributed") == 1) & F.col("attributed_time").isNotNull())
    return statistics(bought.select(seconds_between("attributed_time", "click_time").alias("lag_seconds")), "lag_seconds")


def null_patterns(clicks: DataFrame) -> DataFrame:
    missing = F.col("attributed_time").isNull()
    return clicks.groupBy("is_attributed").agg(_n().alias("n_clicks"), F.count_if(missing).alias("n_null_attributed"), F.count_if(~missing).alias("n_nonnull_attributed")).orderBy("is_attributed")


def anomalies(clicks: DataFrame, clicks_over: int = 500, apps_from: int = 10, k: int = 50) -> DataFrame:
    """The k heaviest and the k widest ips; ties by ip."""
    ips = clicks.groupBy(F.col("ip").cast("long").alias("ip")).agg(_n().alias("n_clicks"), F.count_distinct("app").alias("n_distinct_apps"), F.count_distinct("channel").alias("n_distinct_channels"), _rate().alias("positive_rate"))
    heavy = ips.where(F.col("n_clicks") > clicks_over).orderBy(F.desc("n_clicks"), "ip").limit(k)
    wide = ips.where(F.col("n_distinct_apps") >= apps_from).orderBy(F.desc("n_distinct_apps"), F.desc("n_clicks"), "ip").limit(k)
    return heavy.select(F.lit("high_click_count").alias("bucket"), "*").unionByName(wide.select(F.lit("high_distinct_apps").alias("bucket"), "*")).orderBy("bucket", F.desc("n_clicks"), "ip")


PROFILES = {"e1_class_balance": class_balance, "e2_cardinality": cardinality, "e3_top_values": top_values, "e4_temporal": temporal, "e5_ip_concentration": ip_concentration, "e6_ip_app_pairs": ip_app_pairs, "e7_inter_click_time": inter_click_time, "e8_attributed_lag": attributed_lag, "e9_null_patterns": null_patterns, "e10_anomalies": anomalies}


def run_profiles(clicks: DataFrame, out_dir: str) -> list[str]:
    """Write every profile as CSV under its name; returns the names in order."""
    from ..sources.clicks import write_csv

    for name in sorted(PROFILES):
        write_csv(PROFILES[name](clicks), f"{out_dir}/{name}")
    return sorted(PROFILES)
