"""Strictly prior windows: at time t, only rows in [t - span, t - 1 ms] count.

Times are microseconds, so frames are ranges of longs. Counts and sums over a
span are differences of two unbounded prefixes, which Spark computes
incrementally, in one sort of the partition. Distinct counts come from presence
segments.

No task holds a whole hot key. A key with more than SLICE_ROWS rows is cut into
time slices, as narrow as its busiest hour asks for; windows are over (key, slice),
and what a slice needs to know of those before it (totals, last click, open
segments, last value) is scanned over a table of a row a slice and carried in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_once

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Rows of a key beyond which it is cut into slices, and of a slice, about.
SLICE_ROWS = 200_000
#: Rows of a table of slices up to which it is broadcast.
BROADCAST_ROWS = 500_000
GAP = 1_000  # the frame ends 1 ms before t
FIRST = Window.unboundedPreceding


def micros(time: str = "click_time") -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("__t", micros())


def prior_count(keys: list[str], span: int | None) -> Column:
    """Rows of the key in the span before t; over timed(df)."""
    return prior_sum(F.lit(1), keys, span)


def prior_sum(value: Column, keys: list[str], span: int | None) -> Column:
    w = Window.partitionBy(*keys).orderBy("__t")
    total = F.coalesce(F.sum(value).over(w.rangeBetween(FIRST, -GAP)), F.lit(0))
    if span is None:
        return total
    return total - F.coalesce(F.sum(value).over(w.rangeBetween(FIRST, -span - 1)), F.lit(0))


def prior_rate(value: Column, keys: list[str], span: int | None) -> Column:
    """Mean of value over the span before t; null over an empty window."""
    n = prior_count(keys, span)
    return F.when(n > 0, prior_sum(value.cast("long"), keys, span) / n)


@dataclass(frozen=True)
class Measure:
    """The sum of value (SQL over a row) over the rows of a key, and of by, in [t - span, t - 1 ms]; all earlier rows without a span.

    leaving, if given, is what a row takes away again when it leaves the span: where that is not its value, the sum counts what rows open and close.
    """

    value: str
    span: int | None
    by: str | None = None
    leaving: str | None = None
    kind: str = "bigint"


def sliced(df: DataFrame, key: str, limit: int = SLICE_ROWS, slice_us: int | None = None) -> DataFrame:
    """df (timed) with __w, the width in microseconds of the time slices that the row's key is cut into; null where the key has at most limit rows.

    The width is such that the busiest hour's slices hold about limit rows. With slice_us, every key is cut into slices of that width.
    Where no key has more rows, there is no __w, and what follows has nothing to carry.
    """
    if slice_us is not None:
        return df.withColumn("__w", F.lit(slice_us).cast("long"))
    by_hour = df.groupBy(key, F.expr(f"__t div {HOUR}").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hot = by_hour.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("most")).where(F.col("n") > limit)
    widths = write_once(hot.select(key, F.greatest(F.expr(f"{HOUR} * {limit} div most"), F.lit(1)).alias("__w")), "slices")
    return df if widths.isEmpty() else small_join(df, widths, [key])


def small_join(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df left-joined with a table of hot keys or their slices, written once: broadcast if a count shows that it has at most BROADCAST_ROWS rows, else a shuffle join."""
    kept = write_once(table, "carried")
    return df.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, keys, "left")


def in_slices(df: DataFrame, at: str = "__t") -> DataFrame:
    """df with __s, the slice of the row's key at a time; 0 for a key that is not cut."""
    return df.withColumn("__s", F.coalesce(F.expr(f"{at} div __w"), F.lit(0)) if "__w" in df.columns else F.lit(0).cast("long"))


def cut(df: DataFrame) -> bool:
    return "__w" in df.columns


def neighbours(df: DataFrame, key: str, by: str | None = None, before: str = "__before", after: str = "__after") -> DataFrame:
    """df (sliced) with the times of the rows before and after in the key (and by), in the order of time (and row_id, where there is one); null at the ends.

    What a slice cannot see, the last time of earlier slices and the first of later ones, comes from a table of a row a slice.
    """
    keys = [key, *([by] if by else [])]
    df = in_slices(df)
    w = Window.partitionBy(key, "__s", *keys[1:]).orderBy(*(["__t", "row_id"] if "row_id" in df.columns else ["__t"]))
    out = df.withColumns({before: F.lag("__t").over(w), after: F.lead("__t").over(w)})
    if not cut(df):
        return out.drop("__s")
    spans = df.where(F.col("__w").isNotNull()).groupBy(*keys, "__s").agg(F.min("__t").alias("first"), F.max("__t").alias("last"))
    scan = Window.partitionBy(*keys).orderBy("__s")
    ends = spans.select(*keys, "__s", F.lag("last").over(scan).alias("__earlier"), F.lead("first").over(scan).alias("__later"))
    return small_join(out, ends, [*keys, "__s"]).withColumns({before: F.coalesce(before, "__earlier"), after: F.coalesce(after, "__later")}).drop("__s", "__earlier", "__later")


def carry_scan(df: DataFrame, key: str, measures: Mapping[str, Measure]) -> DataFrame:
    """df (sliced) with a column for each measure: one shuffle by (key, time slice), whatever the number of measures, and no join by row.

    A row adds to its key's totals at t + 1 ms and takes away at t + span + 1 us; these events and the rows themselves are put in order
    within their slices, where running sums give each row its totals. What earlier slices add up to, a row a slice of the keys that are
    cut, is added. The events hold the key and what they add, not the row.
    """
    bys = sorted({m.by for m in measures.values() if m.by})
    zero = {n: F.lit(0).cast(m.kind).alias(n) for n, m in measures.items()}

    def event(delay: int, change: Callable[[Measure], Column | None]) -> Column:
        found = {n: change(m) for n, m in measures.items()}
        return F.struct((F.col("__t") + delay).alias("__at"), F.lit(None).cast(payload).alias("__row"), *[zero[n] if c is None else F.coalesce(c.cast(measures[n].kind), zero[n]).alias(n) for n, c in found.items()])

    payload = df.select(F.struct(*df.columns).alias("r")).schema[0].dataType
    parts = [F.struct(F.col("__t").alias("__at"), F.struct(*df.columns).cast(payload).alias("__row"), *zero.values()), event(GAP, lambda m: F.expr(m.value))]
    for span in sorted({m.span for m in measures.values() if m.span is not None}):
        parts.append(event(span + 1, lambda m, span=span: -F.expr(m.leaving or m.value) if m.span == span else None))
    records = in_slices(df.select(key, *bys, *(["__w"] if cut(df) else []), F.inline(F.array(*parts))), "__at")
    groups = [([key, *([by] if by else [])], [n for n, m in measures.items() if m.by == by]) for by in (None, *bys)]
    groups = [(keys, names) for keys, names in groups if names]
    running = {n: F.sum(n).over(Window.partitionBy(key, "__s", *keys[1:]).orderBy("__at").rangeBetween(FIRST, 0)) for keys, names in groups for n in names}
    out = records.withColumns({f"__r_{n}": c for n, c in running.items()}).where(F.col("__row").isNotNull())
    if not cut(df):
        return out.select("__row.*", *[F.col(f"__r_{n}").cast(m.kind).alias(n) for n, m in measures.items()])
    for keys, names in groups:
        totals = records.where(F.col("__w").isNotNull()).groupBy(*keys, "__s").agg(*[F.sum(n).alias(n) for n in names])
        earlier = Window.partitionBy(*keys).orderBy("__s").rangeBetween(FIRST, -1)
        out = small_join(out, totals.select(*keys, "__s", *[F.sum(n).over(earlier).alias(f"__c_{n}") for n in names]), [*keys, "__s"])
    return out.select("__row.*", *[(F.col(f"__r_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).cast(m.kind).alias(n) for n, m in measures.items()])


def sliced_prior(df: DataFrame, key: str, value: Column, spans: Mapping[str, int | None], slice_us: int | None = None) -> DataFrame:
    """df with <name>_n and <name>_sum for each span of the key."""
    measures = {}
    for name, span in spans.items():
        measures |= {f"{name}_n": Measure("1", span), f"{name}_sum": Measure("__v", span)}
    return carry_scan(sliced(timed(df).withColumn("__v", value), key, slice_us=slice_us), key, measures).drop("__t", "__w", "__v")


def opens(span: int, before: str = "__before") -> Column:
    """1 where the row's item was out of sight just before it comes into sight, else 0.

    A row is in sight from 1 ms after it to span after it. Rows of an item whose sights touch are a segment: it opens with the first
    of them and closes span after the last, so an item counts once however often it occurs.
    """
    return F.when(F.coalesce(F.col("__t") - F.col(before) <= span - GAP + 1, F.lit(False)), 0).otherwise(1)


def closes(span: int, after: str = "__after") -> Column:
    """1 where no row of the item follows before this one is out of sight, else 0."""
    return F.when(F.coalesce(F.col(after) - F.col("__t") <= span - GAP + 1, F.lit(False)), 0).otherwise(1)


def presence_counts(df: DataFrame, key: str, items: Mapping[str, str], span: int = DAY, slice_us: int | None = None) -> DataFrame:
    """df with one column for each name -> item: the distinct items of the key in the span before t."""
    out, measures = sliced(timed(df), key, slice_us=slice_us), {}
    for i, (name, item) in enumerate(items.items()):
        out = neighbours(out, key, item, f"__b{i}", f"__a{i}").withColumns({f"__o{i}": opens(span, f"__b{i}"), f"__z{i}": closes(span, f"__a{i}")}).drop(f"__b{i}", f"__a{i}")
        measures[name] = Measure(f"__o{i}", span, leaving=f"__z{i}")
    return carry_scan(out, key, measures).select(*df.columns, *items)


def asof_last(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, delay_us: int = 0, limit: int = SLICE_ROWS) -> DataFrame:
    """left with the value of the latest right row of the key at or before left_time - delay; null if there is none.

    Both sides are put in order within time slices of the key; a slice starts with the last value of the slices before it.
    """
    shift = F.unix_micros(F.col(right_time).cast("timestamp")) + delay_us
    r = right.select(F.col(key), shift.alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(value)).alias("__v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    asked = left.select(F.col(key), F.unix_micros(F.col(left_time).cast("timestamp")).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    both = in_slices(sliced(asked.unionByName(r), key, limit))
    w = Window.partitionBy(key, "__s").orderBy("__t", "__side").rowsBetween(FIRST, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    if not cut(both):
        return found.select("__row.*", F.col(f"__v.{value}").alias(value))
    lasts = both.where(F.col("__w").isNotNull()).groupBy(key, "__s").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__t", "__v"))).alias("last"))
    carried = lasts.select(key, "__s", F.last("last", ignorenulls=True).over(Window.partitionBy(key).orderBy("__s").rowsBetween(FIRST, -1))["__v"].alias("__carried"))
    return small_join(found, carried, [key, "__s"]).select("__row.*", F.coalesce("__v", "__carried")[value].alias(value))


def sessionize(df: DataFrame, key: str, gap_us: int = DAY, limit: int = SLICE_ROWS) -> DataFrame:
    """(key, segment, first, last, n_clicks): a new segment after a gap over gap_us. Sessions are numbered within time slices; the numbers of earlier slices are added."""
    out = neighbours(sliced(timed(df), key, limit), key)
    out = in_slices(out.withColumn("__new", F.when(F.coalesce(F.col("__t") - F.col("__before") <= gap_us, F.lit(False)), 0).otherwise(1)))
    order = Window.partitionBy(key, "__s").orderBy("__t", "row_id").rowsBetween(FIRST, 0)
    part = out.withColumn("segment", F.sum("__new").over(order)).groupBy(key, "__s", "segment").agg(F.min("click_time").alias("first"), F.max("click_time").alias("last"), F.count(F.lit(1)).alias("n_clicks"))
    if not cut(out):
        return part.drop("__s")
    opened = out.where(F.col("__w").isNotNull()).groupBy(key, "__s").agg(F.sum("__new").alias("n"))
    carried = opened.select(key, "__s", F.sum("n").over(Window.partitionBy(key).orderBy("__s").rowsBetween(FIRST, -1)).alias("__c"))
    numbered = small_join(part, carried, [key, "__s"]).withColumn("segment", F.col("segment") + F.coalesce("__c", F.lit(0)))
    return numbered.groupBy(key, "segment").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_clicks").alias("n_clicks"))
