"""Velocity counts, strictly prior features and routing as streams of clicks."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.triage import fraud_score, route
from ..sources import audit
from ..sources.shared import shared_path

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def click_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1, closing: bool = False) -> DataFrame:
    """The events table as a stream of (row_id, ip, click_time, is_attributed), in the order of time.

    Rows that come a day late are left out behind a watermark, and the table's files may be in any order, so the stream reads a copy ranged by time.
    closing: with_closing.
    """
    clicks = stream_clicks(spark, sf_dir)
    clicks = with_closing(clicks) if closing else clicks
    path = shared_path(spark, "clicks-by-time")
    clicks.repartitionByRange("click_time").write.parquet(path)
    return file_stream(spark, path, clicks.schema, files_per_trigger)


def stream_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("event_id") + 1).alias("row_id"), F.col("user_id").cast("int").alias("ip"), F.col("ts").cast("timestamp").alias("click_time"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("is_attributed"))


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder's files as a stream, in the order of their numbers."""
    order_files(spark, path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_closing(clicks: DataFrame, days: int = 3) -> DataFrame:
    """clicks and one row of no ip, days after the last: it moves the watermark past all windows, so that a finite stream gives them all out."""
    last = clicks.agg((F.max("click_time") + F.make_dt_interval(F.lit(days))).alias("click_time"))
    return clicks.unionByName(last, allowMissingColumns=True)


def order_files(spark: SparkSession, path: str) -> None:
    """Date the part files one second apart in the order of their numbers: a file stream takes the oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    now = int(time.time())
    for i, f in enumerate(sorted(parts, key=lambda f: (int(f.getName().split("-")[1]), f.getName()))):
        fs.setTimes(f, (now + i) * 1000, -1)


#: Rows of a file of write_turns, about, in the smallest turn.
TURN_ROWS = 20_000


def write_turns(clicks: DataFrame, turn: Column, turns: int, path: str, rows: int = TURN_ROWS) -> int:
    """Write clicks so that a file stream takes turn 0 first, then turn 1, and so on; returns how many files a turn has, the same for all: a batch.

    The number grows with the smallest turn, so that no task reads a whole turn. Rows are dealt to a turn's files by a hash, which leaves none of
    them empty.
    """
    counts = {r["turn"]: r["count"] for r in clicks.groupBy(turn.alias("turn")).count().collect()}  # a row a turn
    files = max(1, min(counts.get(i, 0) for i in range(turns)) // rows)
    clicks.repartitionById(turns * files, (turn * files + F.pmod(F.xxhash64(*clicks.columns), F.lit(files))).cast("int")).write.parquet(path)
    return files


def windowed_counts(clicks: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(ip, start, n_clicks) of tumbling windows, given out in append mode when the watermark has passed them; their state goes then.

    Clicks of windows that are closed are left out: late_clicks collects them.
    """
    w = F.window("click_time", width)
    return clicks.withWatermark("click_time", late).groupBy("ip", w).agg(F.count(F.lit(1)).alias("n_clicks")).select("ip", F.col("window.start").alias("start"), "n_clicks")


def sessions(clicks: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(ip, start, end, n_clicks) of sessions that a gap ends."""
    w = F.session_window("click_time", gap)
    return clicks.withWatermark("click_time", late).groupBy("ip", w).agg(F.count(F.lit(1)).alias("n_clicks")).select("ip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_clicks")


class PriorCounts(StatefulProcessor):
    """Of each click, how many clicks and attributed clicks of its ip the last span holds. A group is a shard of ips, so that a batch calls the state a few
    times a shard and hour, whatever the number of ips.

    The state is two maps by time bucket, packed as int64: the clicks (ip, time, label) and each ip's totals (ip, n, y). Whole buckets of a span
    are read as totals and only those at its two ends as clicks; a batch writes the buckets that it has clicks in, whatever the history. A timer
    removes each bucket.
    """

    def __init__(self, span_us: int, bucket_us: int):
        self.span, self.bucket = span_us, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "bucket long", "packed binary")
        self.rows = handle.getMapState("rows", "bucket long", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        at = new["click_time"].astype("datetime64[us]").astype("int64").to_numpy()
        ips = new["ip_code"].to_numpy()
        clicks = np.stack([ips, at, new["is_attributed"].to_numpy().astype("int64")])
        own, since, until = at // self.bucket, (at - self.span - 1) // self.bucket, (at - 1000) // self.bucket
        held: dict[int, np.ndarray] = {}
        for b in np.unique(own).tolist():
            before = _packed(self.rows, b)
            held[b] = np.concatenate([before, clicks[:, own == b]], axis=1)
            found, which = np.unique(held[b][0], return_inverse=True)
            totals = np.zeros((3, len(found)), "int64")
            totals[0] = found
            np.add.at(totals[1], which, 1)
            np.add.at(totals[2], which, held[b][2])
            self.rows.updateValue((b,), (held[b].tobytes(),))
            self.totals.updateValue((b,), (totals.tobytes(),))
            if not before.shape[1]:
                self.handle.registerTimer((b + 1) * self.bucket // 1000 + self.span // 1000 * 3)
        ends = {*since.tolist(), *until.tolist()}
        parts = []
        for b in sorted({b for first, last in set(zip(since.tolist(), until.tolist(), strict=True)) for b in range(first, last + 1)}):
            if b in ends:
                ip, t, y = held[b] if b in held else _packed(self.rows, b)
                parts.append(np.stack([ip, t, np.ones_like(ip), y]))
            else:  # no span ends within the bucket, so its totals may stand at its start
                ip, n, y = _packed(self.totals, b)
                parts.append(np.stack([ip, np.full_like(ip, b * self.bucket), n, y]))
        n1, y1, n0, y0 = _sums(np.concatenate(parts, axis=1), ips, at - 1000, at - self.span - 1)
        n, y = n1 - n0, y1 - y0
        rate = pd.Series(np.divide(y, n, out=np.zeros(len(n)), where=n > 0)).astype(object).where(n > 0, None)
        yield pd.DataFrame({"row_id": new["row_id"], "ip": pd.Series(ips).where(ips != NO_IP).astype("Int32"), "clicks_before": n, "rate_before": rate})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = (expiredTimerInfo.getExpiryTimeInMs() - self.span // 1000 * 3) * 1000 // self.bucket - 1
        self.rows.removeKey((b,))
        self.totals.removeKey((b,))
        return iter([])

    def close(self) -> None:
        pass


def _packed(state: MapState, bucket: int) -> np.ndarray:
    """A bucket's three columns, without rows where the state has none."""
    return np.frombuffer(state.getValue((bucket,))[0] if state.containsKey((bucket,)) else b"", "int64").reshape(3, -1)


def _sums(counted: np.ndarray, ips: np.ndarray, *times: np.ndarray) -> list[np.ndarray]:
    """n and y, for each of times, summed over the counted (ip, time, n, y) at or before it: of the ip, and of all ips before it in order."""
    asked = len(ips) * len(times)
    ip, t = np.concatenate([counted[0], *[ips] * len(times)]), np.concatenate([counted[1], *times])
    asks = np.concatenate([np.zeros(counted.shape[1], "int8"), np.ones(asked, "int8")])
    order = np.lexsort((asks, t, ip))
    back = np.empty(len(order), "int64")
    back[order] = np.arange(len(order))
    total = [np.cumsum(np.concatenate([c, np.zeros(asked, "int64")])[order])[back[counted.shape[1] :]].reshape(len(times), -1) for c in counted[2:]]
    return [c[i] for i in range(len(times)) for c in total]


#: Shards of ips with a state of their own each. A stream that goes on from a checkpoint has the number that it had.
SHARDS = 64
NO_IP = 1 << 40  # beyond every int


def prior_features(clicks: DataFrame, span_ms: int = DAY_MS, bucket_ms: int = HOUR_MS, shards: int = SHARDS) -> DataFrame:
    """(row_id, ip, clicks_before, rate_before): counts over [t - span, t - 1 ms], emitted when the click comes.

    Rows later than a day are left out. The state store must be RocksDB: run_to_table(..., rocksdb=True) sees to it.
    """
    coded = clicks.select("row_id", "click_time", "is_attributed", F.coalesce(F.col("ip").cast("long"), F.lit(NO_IP)).alias("ip_code")).withColumn("shard", F.pmod(F.xxhash64("ip_code"), F.lit(shards)).cast("int"))
    return (
        coded.withWatermark("click_time", "1 day").groupBy("shard")
        .transformWithStateInPandas(PriorCounts(span_ms * 1000, bucket_ms * 1000), "row_id long, ip int, clicks_before long, rate_before double", "append", "EventTime")
    )


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Run the stream over what is there now, into Parquet in the shared folder (complete results: the last batch).

    Each batch has a folder of its number, so a batch that is run again replaces what it wrote before.
    """
    out, log = shared_path(spark, name), checkpoint or shared_path(spark, f"{name}-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={number}")

    before = spark.conf.get(_STATE_STORE)
    if rocksdb:
        spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def stream_route(spark: SparkSession, scored: DataFrame, log_path: str, block: float, review: float, rate: float = 0.005, seed: int = 42, checkpoint: str | None = None, name: str = "route"):
    """Start a stream of (case_id, click_time, p): score, route and append each batch to the audit log, repeated cases once.

    A batch goes to the log under the stream's name and its number, with a commit record: a batch that is run again after a failure is there once.
    A stream that is to go on after a stop is given the checkpoint and the name that it had.
    """
    once = scored.withWatermark("click_time", "1 day").dropDuplicatesWithinWatermark(["case_id"])
    ready = once.withColumns({"fraud_score": fraud_score("p"), "raw_score": F.col("p"), "calibrated_score": F.col("p")})

    def write(batch: DataFrame, number: int) -> None:
        routed = route(batch, block, review, rate, seed).withColumn("click_time", F.col("click_time").cast("timestamp_ntz"))
        audit.append(audit.rows(routed, "stream-v1", "cost-v1", block, review), log_path, f"{name}-{number}")

    return ready.writeStream.option("checkpointLocation", checkpoint or shared_path(spark, "route-log")).trigger(availableNow=True).foreachBatch(write).start()


def late_clicks(spark: SparkSession, clicks: DataFrame, name: str, width_s: int = 3600, late_s: int = 86400, checkpoint: str | None = None) -> DataFrame:
    """The clicks that windowed_counts leaves out, as a table: those whose window was closed when they came, with the batch that they came in.

    A window is closed when the watermark of the batch before has reached its end, by which Spark judges too: the latest click of all batches up to the
    last but one, less the delay. What each batch's latest
    click was is kept beside the table, a row a batch, so a stream that goes on after a stop knows its watermark.
    """
    out, log = shared_path(spark, name), checkpoint or shared_path(spark, f"{name}-log")
    folders = {k: f"{log}-{k}" for k in ("latest", "rows")} if checkpoint else {k: f"{out}-{k}" for k in ("latest", "rows")}

    def write(batch: DataFrame, number: int) -> None:
        batch.agg(F.max("click_time").alias("latest")).write.mode("overwrite").parquet(f"{folders['latest']}/batch={number}")
        before = spark.read.schema("latest timestamp, batch int").parquet(folders["latest"]).where(F.col("batch") < number - 1).agg(F.max("latest")).first()[0]
        mark = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(late_s))
        closed = F.window("click_time", f"{width_s} seconds")["end"] <= mark
        batch.where(F.lit(before is not None) & F.coalesce(closed, F.lit(False))).write.mode("overwrite").parquet(f"{folders['rows']}/batch={number}")

    clicks.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in clicks.dtypes)}, batch int").parquet(folders["rows"])
