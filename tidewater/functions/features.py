"""The 28 features: 8 of the click itself, 6 of velocity, 14 of history, from sums over the clicks before (windows.carry_scan)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import DAY, HOUR, SLICE_ROWS, Measure, carry_scan, closes, neighbours, opens, sliced, timed
from ..sources.shared import write_once


def per_click() -> dict[str, Column]:
    text = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string"))
    return {
        "f1_app_id": F.col("app"),
        "f1_channel_id": F.col("channel"),
        "f1_device_id": F.col("device"),
        "f1_os_id": F.col("os"),
        "f1_hour_of_day": F.hour("click_time").cast("long"),
        "f1_day_of_week": (F.weekday("click_time") + 1).cast("long"),
        "f1_ip_app_interaction": text("ip", "app"),
        "f1_ip_device_interaction": text("ip", "device"),
    }


_GAP = "f2_inter_click_time_seconds"
_LOW, _HIGH = f"({_GAP} & 1048575)", f"shiftright({_GAP}, 20)"
#: Parts of a gap's square, high * high * 2^40 + 2 * high * low * 2^20 + low * low: sums of longs, that cost a fraction of one of decimals. None can
#: overflow, as an ip's gaps add up to less than 2^38 seconds.
_SQUARES = {"hh": f"{_HIGH} * {_HIGH}", "hl": f"{_HIGH} * {_LOW}", "ll": f"{_LOW} * {_LOW}"}
#: What is summed over the rows of an ip, or of an (ip, app), before each row: SQL over a row.
IP_MEASURES: dict[str, Measure] = {
    "ip_n_1h": Measure("1", HOUR), "ip_n_24h": Measure("1", DAY), "ip_y_24h": Measure("is_attributed", DAY), "ip_n": Measure("1", None), "ip_y": Measure("is_attributed", None),
    "pair_n_1h": Measure("1", HOUR, "app"), "pair_n_24h": Measure("1", DAY, "app"), "pair_y_24h": Measure("is_attributed", DAY, "app"), "pair_n": Measure("1", None, "app"), "pair_y": Measure("is_attributed", None, "app"),
    "gap_n": Measure(f"if({_GAP} IS NOT NULL, 1, 0)", DAY), "gap_s": Measure(_GAP, DAY), **{f"gap_{x}": Measure(v, DAY) for x, v in _SQUARES.items()},
    **{f"ip_{c}s": Measure(f"{c}_opens", DAY, leaving=f"{c}_closes") for c in ("app", "device", "os")},
}
APP_MEASURES: dict[str, Measure] = {
    "app_n_24h": Measure("1", DAY), "app_y_24h": Measure("is_attributed", DAY), "app_n": Measure("1", None), "app_y": Measure("is_attributed", None),
    "app_ips": Measure("app_opens", DAY, leaving="app_closes"),
}


def _rate(y: str, n: str) -> str:
    return f"if({n} > 0, {y} / {n}, NULL)"


#: 1 where more than 10 clicks in the hour before and under 60 s since the last; a first click is 0.
_BURST = f"CASE WHEN ip_n_1h > 10 AND {_GAP} < 60 THEN 1 ELSE 0 END"
#: Sample deviation of the gaps. Nothing cancels: n * sum(x^2) - sum(x)^2 is computed in whole numbers (decimals of 38 digits) and only then divided.
_SQUARE_SUM = "CAST(gap_hh AS DECIMAL(19,0)) * 1099511627776BD + CAST(gap_hl AS DECIMAL(19,0)) * 2097152BD + CAST(gap_ll AS DECIMAL(19,0))"
_WIDE_SPREAD = f"CAST(CAST(CAST(gap_n AS DECIMAL(19,0)) * CAST({_SQUARE_SUM} AS DECIMAL(30,0)) AS DECIMAL(38,0)) - CAST(CAST(gap_s AS DECIMAL(19,0)) * CAST(gap_s AS DECIMAL(19,0)) AS DECIMAL(38,0)) AS DOUBLE)"
#: In longs where they hold it: the square of the sum is at most n times the sum of squares.
_SPREAD = f"if(gap_hh = 0 AND gap_n < 1048576 AND gap_ll < 4398046511104, CAST(gap_n * gap_ll - gap_s * gap_s AS DOUBLE), {_WIDE_SPREAD})"
_DEVIATION = f"if(gap_n > 1, sqrt(({_SPREAD}) / (gap_n * (gap_n - 1))), NULL)"

#: The features of each pass, as SQL over the measures: of the clicks before with the same ip (and app), and with the same app.
IP_FEATURES: dict[str, str] = {
    "f2_clicks_per_ip_last_1hr": "ip_n_1h", "f2_clicks_per_ip_last_24hr": "ip_n_24h", "f2_clicks_per_ip_app_last_1hr": "pair_n_1h",
    "f2_inter_click_time_seconds": _GAP, "f2_ip_click_std_inter_arrival": _DEVIATION, "f2_burst_score": _BURST,
    "f3_ip_conversion_rate_24hr": _rate("ip_y_24h", "ip_n_24h"), "f3_ip_conversion_rate_alltime": _rate("ip_y", "ip_n"), "f3_ip_clicks_alltime": "ip_n",
    "f3_ip_app_conversion_rate_24hr": _rate("pair_y_24h", "pair_n_24h"), "f3_ip_app_clicks_24hr": "pair_n_24h",
    "f3_ip_app_conversion_rate_alltime": _rate("pair_y", "pair_n"), "f3_ip_app_clicks_alltime": "pair_n",
    "f3_ip_distinct_apps_24hr": "ip_apps", "f3_ip_distinct_devices_24hr": "ip_devices", "f3_ip_distinct_oses_24hr": "ip_oss",
}
APP_FEATURES: dict[str, str] = {
    "f3_app_conversion_rate_24hr": _rate("app_y_24h", "app_n_24h"), "f3_app_conversion_rate_alltime": _rate("app_y", "app_n"),
    "f3_app_clicks_alltime": "app_n", "f3_app_distinct_ips_24hr": "app_ips",
}

#: All names in their order, with the frozen types.
FEATURES: dict[str, str] = {
    "f1_app_id": "int", "f1_channel_id": "int", "f1_device_id": "int", "f1_os_id": "int",
    "f1_hour_of_day": "bigint", "f1_day_of_week": "bigint", "f1_ip_app_interaction": "string", "f1_ip_device_interaction": "string",
    "f2_clicks_per_ip_last_1hr": "bigint", "f2_clicks_per_ip_last_24hr": "bigint", "f2_clicks_per_ip_app_last_1hr": "bigint",
    "f2_inter_click_time_seconds": "bigint", "f2_ip_click_std_inter_arrival": "double", "f2_burst_score": "tinyint",
    "f3_ip_conversion_rate_24hr": "double", "f3_app_conversion_rate_24hr": "double",
    "f3_ip_distinct_apps_24hr": "bigint", "f3_ip_distinct_devices_24hr": "bigint", "f3_ip_distinct_oses_24hr": "bigint",
    "f3_ip_app_conversion_rate_24hr": "double", "f3_ip_app_clicks_24hr": "bigint", "f3_app_distinct_ips_24hr": "bigint",
    "f3_ip_conversion_rate_alltime": "double", "f3_ip_clicks_alltime": "bigint", "f3_app_conversion_rate_alltime": "double",
    "f3_app_clicks_alltime": "bigint", "f3_ip_app_conversion_rate_alltime": "double", "f3_ip_app_clicks_alltime": "bigint",
}
NUMERIC = [n for n, t in FEATURES.items() if t != "string"]


def with_edges(clicks: DataFrame, items: tuple[str, ...] = ("app", "device", "os"), limit: int = SLICE_ROWS) -> DataFrame:
    """clicks with the seconds since the ip's click before, and where the segments of each item of an ip open and close."""
    out = neighbours(sliced(timed(clicks), "ip", limit), "ip")
    seconds = lambda t: F.floor(F.col(t) / 1_000_000)
    out = out.withColumn("f2_inter_click_time_seconds", (seconds("__t") - seconds("__before")).cast("long")).drop("__before", "__after")
    for c in items:
        out = neighbours(out, "ip", c).withColumns({f"{c}_opens": opens(DAY).cast("byte"), f"{c}_closes": closes(DAY).cast("byte")}).drop("__before", "__after")
    return out.drop("__t", "__w")


def with_ip_features(edges: DataFrame, names: Iterable[str] = tuple(IP_FEATURES), measures: Iterable[str] = tuple(IP_MEASURES), limit: int = SLICE_ROWS) -> DataFrame:
    """with_edges(clicks) with features of the ip and of the (ip, app): one shuffle by (ip, time slice)."""
    out = carry_scan(sliced(timed(edges), "ip", limit), "ip", {m: IP_MEASURES[m] for m in measures})
    return out.withColumns({n: F.expr(IP_FEATURES[n]).cast(FEATURES[n]) for n in names}).drop(*measures, "__t", "__w")


def with_app_features(edges: DataFrame, names: Iterable[str] = tuple(APP_FEATURES), measures: Iterable[str] = tuple(APP_MEASURES), limit: int = SLICE_ROWS) -> DataFrame:
    """with_edges(clicks) with features of the app: one shuffle by (app, time slice)."""
    out = carry_scan(sliced(timed(edges), "app", limit), "app", {m: APP_MEASURES[m] for m in measures})
    return out.withColumns({n: F.expr(APP_FEATURES[n]).cast(FEATURES[n]) for n in names}).drop(*measures, "__t", "__w")


#: What a feature reads: its measures, and the items whose segments they count.
_READS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "f2_clicks_per_ip_last_1hr": (("ip_n_1h",), ()), "f2_clicks_per_ip_last_24hr": (("ip_n_24h",), ()), "f2_clicks_per_ip_app_last_1hr": (("pair_n_1h",), ()),
    "f2_ip_click_std_inter_arrival": (("gap_n", "gap_s", *(f"gap_{x}" for x in _SQUARES)), ()), "f2_burst_score": (("ip_n_1h",), ()),
    "f3_ip_conversion_rate_24hr": (("ip_n_24h", "ip_y_24h"), ()), "f3_ip_conversion_rate_alltime": (("ip_n", "ip_y"), ()), "f3_ip_clicks_alltime": (("ip_n",), ()),
    "f3_ip_app_conversion_rate_24hr": (("pair_n_24h", "pair_y_24h"), ()), "f3_ip_app_clicks_24hr": (("pair_n_24h",), ()),
    "f3_ip_app_conversion_rate_alltime": (("pair_n", "pair_y"), ()), "f3_ip_app_clicks_alltime": (("pair_n",), ()),
    "f3_ip_distinct_apps_24hr": (("ip_apps",), ("app",)), "f3_ip_distinct_devices_24hr": (("ip_devices",), ("device",)), "f3_ip_distinct_oses_24hr": (("ip_oss",), ("os",)),
    "f3_app_conversion_rate_24hr": (("app_n_24h", "app_y_24h"), ()), "f3_app_conversion_rate_alltime": (("app_n", "app_y"), ()),
    "f3_app_clicks_alltime": (("app_n",), ()), "f3_app_distinct_ips_24hr": (("app_ips",), ("app",)),
}
_READS_GAP = ("f2_inter_click_time_seconds", "f2_ip_click_std_inter_arrival", "f2_burst_score")


def feature(clicks: DataFrame, name: str, limit: int = SLICE_ROWS) -> DataFrame:
    """(row_id, <name>): one feature by itself, from the measures that it reads and no others."""
    if name in per_click():
        return clicks.select("row_id", per_click()[name].alias(name))
    measures, items = _READS.get(name, ((), ()))
    rows = with_edges(clicks, items, limit) if items or name in _READS_GAP else clicks
    if not measures:
        return rows.select("row_id", name)
    scan = with_app_features if name in APP_FEATURES else with_ip_features
    return scan(rows, (name,), measures, limit).select("row_id", name)


#: The passes over the clicks, in their order: each a shuffle of the clicks and a function of the table before.
PASSES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "edges": lambda clicks, limit: with_edges(clicks, limit=limit),
    "ip": lambda edges, limit: with_ip_features(edges, limit=limit),
    "app": lambda rows, limit: with_app_features(rows, limit=limit).withColumns(per_click()),
}


def all_features(clicks: DataFrame, limit: int = SLICE_ROWS, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """clicks with all 28 features, without a join by row: three passes, each written once (keep(name, pass) keeps them elsewhere or finds them again)."""
    out = clicks
    for name, run in PASSES.items():
        step = lambda out=out, run=run: run(out, limit)
        out = write_once(step(), f"pass-{name}") if keep is None and name != "app" else step() if keep is None else keep(name, step)
    return out.select(*clicks.columns, *[F.col(n).cast(t).alias(n) for n, t in FEATURES.items()])
