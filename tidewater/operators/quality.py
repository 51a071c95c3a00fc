"""Validation of a click table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.clicks import REQUIRED

BALANCE = (0.001, 0.01)
PERIOD = ("2017-11-06 00:00:00", "2017-11-12 00:00:00")


def validate(clicks: DataFrame, balance: tuple[float, float] | None = BALANCE, period: tuple[str, str] = PERIOD) -> DataFrame:
    """(name, ok, detail) of each check: rows, nulls, labels, period (end exclusive) and class balance (None: skipped)."""
    required = [c for c in REQUIRED if c != "row_id"]
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    label = F.col("is_attributed")
    one = clicks.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        F.count_if(~label.isin(0, 1)).alias("bad"), F.min("click_time").alias("lo"), F.max("click_time").alias("hi"), F.avg(label.cast("double")).alias("mean"),
    )
    check = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    checks = [check("row_count", F.col("n") > 0, text("n"))]
    checks += [check(f"not_null_{c}", F.col(f"null_{c}") == 0, text(f"null_{c}")) for c in required]
    checks += [check("label_values", F.col("bad") == 0, text("bad")), check("time_range", (F.col("lo") >= ntz(period[0])) & (F.col("hi") < ntz(period[1])), F.concat_ws(" to ", text("lo"), text("hi")))]
    if balance is not None:
        checks.append(check("class_balance", F.col("mean").between(*balance), F.coalesce(F.round("mean", 6).cast("string"), F.lit("none"))))
    return one.select(F.inline(F.array(*checks)))


def summary(clicks: DataFrame, balance: tuple[float, float] | None = BALANCE, period: tuple[str, str] = PERIOD) -> dict:
    """{row_count, class_balance, checks, ok, errors}."""
    rows = validate(clicks, balance, period).collect()
    totals = clicks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_attributed").cast("double")).alias("mean")).first()
    return {"row_count": totals["n"], "class_balance": totals["mean"], "checks": [r.asDict() for r in rows], "ok": all(r["ok"] for r in rows), "errors": [f"{r['name']}: {r['detail']}" for r in rows if not r["ok"]]}


def exactly_one(df: DataFrame):
    """The only row of df; none or several raise."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row, got {'none' if not rows else 'more'}")
    return rows[0]
