"""The click table: schema, CSV scan, ingest with a stable row id, time splits, and the adapter from the events table."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ranged

#: Fixed schema of the CSV source; nothing is inferred.
CLICKS = T.StructType([
    T.StructField("ip", T.IntegerType()),
    T.StructField("app", T.IntegerType()),
    T.StructField("device", T.IntegerType()),
    T.StructField("os", T.IntegerType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("click_time", T.TimestampNTZType()),
    T.StructField("attributed_time", T.TimestampNTZType()),
    T.StructField("is_attributed", T.ByteType()),
])
REQUIRED = ("row_id", "ip", "app", "device", "os", "channel", "click_time", "is_attributed")
ROW_ORDER = ("click_time", "ip", "app", "device", "os", "channel")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLICKS).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)


def with_row_id(clicks: DataFrame) -> DataFrame:
    """Number the rows 1..N by time, ip, app, device, os, channel.

    Rows are numbered within range partitions of that order, and the rows of the parts before (one number a part) are added.
    """
    parts = ranged(clicks, *ROW_ORDER)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy("__part").orderBy(*ROW_ORDER)
    numbered = parts.withColumn("__at", F.row_number().over(own)).join(F.broadcast(offsets), "__part")
    return numbered.select((F.col("__offset") + F.col("__at")).cast("long").alias("row_id"), *clicks.columns)


def ingest_csv(spark: SparkSession, csv_path: str, out_path: str) -> int:
    """Scan a CSV, add row ids, write the click table sorted by time (replacing it); returns the number of rows."""
    table = with_row_id(read_csv(spark, csv_path))
    table.repartitionByRange("click_time").sortWithinPartitions("click_time", "row_id").write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path).count()


def write_csv(df: DataFrame, path: str) -> None:
    """One small result as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as clicks."""
    k = F.get_json_object("props", "$.k").cast("int")
    bought = F.col("event_type") == "purchase"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)
    return e.select(
        (F.col("event_id") + 1).alias("row_id"),
        F.col("user_id").cast("int").alias("ip"),
        (F.col("k") % 20).alias("app"),
        (F.col("k") % 3).alias("device"),
        (F.col("k") % 7).alias("os"),
        F.col("k").alias("channel"),
        F.col("ts").cast("timestamp_ntz").alias("click_time"),
        F.when(bought, F.expr("cast(ts as timestamp_ntz) + make_dt_interval(0, 0, 0, cast(round(value, 6) as decimal(18, 6)))")).alias("attributed_time"),
        F.when(bought, 1).otherwise(0).cast("byte").alias("is_attributed"),
    )


class Split(NamedTuple):
    name: str
    start: str | None
    end: str | None


#: The splits of the events adapter; real data bring their own.
EVENT_SPLITS = (Split("train", None, "2024-01-19 00:00:00"), Split("val", "2024-01-19 00:00:00", "2024-01-25 00:00:00"), Split("test", "2024-01-25 00:00:00", None))


def split_predicate(name: str, splits: tuple[Split, ...] = EVENT_SPLITS, time: str = "click_time") -> Column:
    """click_time in [start, end) of the split; an unknown name raises."""
    found = next((s for s in splits if s.name == name), None)
    if found is None:
        raise ValueError(f"unknown split {name!r}; known: {[s.name for s in splits]}")
    ok = F.lit(True)
    if found.start is not None:
        ok = ok & (F.col(time) >= F.lit(found.start).cast("timestamp_ntz"))
    if found.end is not None:
        ok = ok & (F.col(time) < F.lit(found.end).cast("timestamp_ntz"))
    return ok


def apply_split(df: DataFrame, name: str, splits: tuple[Split, ...] = EVENT_SPLITS) -> DataFrame:
    if name == "test":
        warnings.warn("the test split is for the final evaluation only", stacklevel=2)
    return df.where(split_predicate(name, splits))


def split_name(splits: tuple[Split, ...] = EVENT_SPLITS) -> Column:
    name = F.lit(None).cast("string")
    for s in reversed(splits):
        name = F.when(split_predicate(s.name, splits), s.name).otherwise(name)
    return name


def create_split_views(clicks: DataFrame, splits: tuple[Split, ...] = EVENT_SPLITS) -> DataFrame:
    """Register clicks_<split> views; returns (split, n_rows) from one pass."""
    for s in splits:
        clicks.where(split_predicate(s.name, splits)).createOrReplaceTempView(f"clicks_{s.name}")
    return clicks.groupBy(split_name(splits).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))


def split_ranges(clicks: DataFrame, splits: tuple[Split, ...] = EVENT_SPLITS) -> DataFrame:
    """(name, start, end_exclusive); the first split starts at the data's minimum."""
    names = F.array(*[F.struct(F.lit(s.name).alias("name"), F.lit(s.start).cast("timestamp_ntz").alias("start"), F.lit(s.end).cast("timestamp_ntz").alias("end_exclusive")) for s in splits])
    least = clicks.agg(F.min("click_time").alias("least"))
    return least.select("least", F.inline(names)).select("name", F.coalesce("start", "least").alias("start"), "end_exclusive")
