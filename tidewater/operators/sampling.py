"""Deterministic samples and draws by hashes of the id: stable under repartitioning, equal in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(row_id: str | Column = "row_id") -> Column:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(c.cast("string").cast("binary"))


def draw(key: str | Column, seed: str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(key || seed)."""
    c = F.col(key) if isinstance(key, str) else key
    bits = F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(str(seed))).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52)


def stratified_sample(df: DataFrame, fraction: float, stratum: Column | None = None) -> DataFrame:
    """ceil(fraction * n) rows of each hour, by hash order. Sample after windows are computed, never before."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, got {fraction}")
    hour = F.date_trunc("hour", "click_time") if stratum is None else stratum
    # Whole bins of hashes lie under or over a stratum's limit; only the one that holds the limit is ranked.
    keyed = df.withColumns({"__stratum": hour, "__key": sample_key()}).withColumn("__bin", F.substring("__key", 1, 3))
    up = Window.partitionBy("__stratum").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 bins a stratum at most
    bins = keyed.groupBy("__stratum", "__bin").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__before": F.coalesce(F.sum("__n").over(up), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy("__stratum"))})
    bins = bins.withColumn("__room", F.ceil(F.col("__all") * fraction) - F.col("__before")).where("__room > 0").select("__stratum", "__bin", "__n", "__room")
    inside = keyed.join(bins, ["__stratum", "__bin"])
    rank = F.row_number().over(Window.partitionBy("__stratum", "__bin").orderBy("__key", "row_id"))
    cut = inside.where("__n > __room").withColumn("__at", rank).where("__at <= __room")
    return inside.where("__n <= __room").select(*df.columns).unionByName(cut.select(*df.columns))


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    return df.where(draw(key, seed) < fraction)


def holdout_split(df: DataFrame, seed: int = 42, share: float = 0.5, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by hash."""
    d = draw(key, seed)
    return df.where(d < share), df.where(d >= share)
