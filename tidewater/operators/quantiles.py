"""Exact quantiles without gathering all values: a histogram, then only the bins that hold the wanted ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def _bin(x: Column, edges: list[float]) -> Column:
    """How many edges are below x, found in two steps of about sqrt(BINS) comparisons."""
    side = max(1, math.isqrt(len(edges)))
    rows = [edges[i : i + side] for i in range(0, len(edges), side)]
    below = lambda a: F.size(F.filter(F.array(*map(F.lit, a)), lambda e: e < x))
    row = below([r[0] for r in rows])
    inner = F.get(F.array(*[F.array(*map(F.lit, r)) for r in rows]), row - 1)
    return F.when(row == 0, 0).otherwise((row - 1) * side + F.size(F.filter(inner, lambda e: e < x)))


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of the non-null values; None without any.

    The values are cut into about BINS bins at approximate quantiles. Of the bins that hold a wanted rank, distinct values are counted and
    numbered; no other value is sorted, and BINS edges, BINS counts and two values a share reach the driver.
    """
    x = F.col(value).cast("double")
    values = df.where(x.isNotNull()).select(x.alias("x"))
    edges = sorted(set(values.agg(F.percentile_approx("x", [i / BINS for i in range(1, BINS)], 20 * BINS).alias("e")).first()["e"] or []))
    if not edges:
        return [None] * len(shares)
    binned = values.select("x", _bin(F.col("x"), edges).alias("bin"))
    sizes = sorted((r["bin"], r["n"]) for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect())
    total, start = sum(n for _, n in sizes), {}
    at = 0
    for b, n in sizes:
        start[b] = at
        at += n
    ranks = {r for q in shares for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}
    wanted = {b for b, n in sizes if any(start[b] <= r < start[b] + n for r in ranks)}
    up = Window.partitionBy("bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = binned.where(F.col("bin").isin(*wanted)).groupBy("bin", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("end", F.sum("n").over(up))
    offset = F.element_at(F.create_map(*[F.lit(v) for b in sorted(wanted) for v in (b, start[b])]), F.col("bin"))
    placed = counted.select("x", (offset + F.col("end") - F.col("n")).alias("first"), (offset + F.col("end")).alias("after"))
    hit = placed.where(" OR ".join(f"(first <= {r} AND {r} < after)" for r in sorted(ranks))).collect()
    found = {r: h["x"] for h in hit for r in ranks if h["first"] <= r < h["after"]}
    out = []
    for q in shares:
        pos = (total - 1) * q
        low, high = found[math.floor(pos)], found[math.ceil(pos)]
        out.append(low + (high - low) * (pos - math.floor(pos)))
    return out
