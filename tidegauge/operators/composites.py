"""Regime composites: declared components, expanding standard scores, means, states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import safe_ratio

Z_MIN, STATE_WINDOW, STATE_MIN = 12, 60, 12

def _level() -> Column:
    """The first source less all others of the component; a missing one makes it NULL."""
    rest = F.aggregate(F.slice("sources", 2, F.size("sources")), F.lit(0.0), lambda total, x: total + x)
    return F.col("s0") - rest


# Row-wise part of each transform over the sources (``s0``, ``s1`` and the list ``sources``), then the window part.
# Callers add or replace transforms by name; both parts are plain column builders.
COMBINE: dict[str, Callable[[], Column]] = {
    "level": _level,
    "level_mom3": _level,
    "ratio": lambda: safe_ratio("s0", "s1"),
    "termstruct": lambda: 1.0 - safe_ratio("s0", "s1"),
}
CHANGE: dict[str, Callable] = {
    "yoy": lambda x, w: W.pct_change(x, 12, w),
    "mom3": lambda x, w: W.diff(x, 3, w),
    "mom1": lambda x, w: W.diff(x, 1, w),
    "level_mom3": lambda x, w: W.diff(x, 3, w),
}


def _dispatch(table: dict, build, default: Column) -> Column:
    out = None
    for name, fn in table.items():
        branch = (F.col("transform") == name, build(fn))
        out = F.when(*branch) if out is None else out.when(*branch)
    return out.otherwise(default)


def components(panel: DataFrame, spec: DataFrame, combine: dict | None = None, change: dict | None = None) -> DataFrame:
    """Sign-aligned standard score of every declared component.

    The spec is exploded to (component, position, source) and joined to the panel by
    series; the sources of a component, however many, meet again in one aggregation. Components with
    a missing source stay in the result as NULL. ``combine`` and ``change`` add transforms by name.
    """
    wanted = spec.select("component", "transform", "sign", "composite", F.size("sources").alias("n_sources"),
                         F.posexplode("sources").alias("pos", "series_id"))
    keys = ["entity_id", "component", "period_end"]
    carried = [F.first(c).alias(c) for c in ("transform", "sign", "composite", "n_sources")]
    met = F.collect_list(F.struct("pos", "value")).alias("_met")
    joined = panel.join(wanted, "series_id").groupBy(*keys).agg(*carried, met)
    at = lambda i: F.array_max(F.transform(F.filter("_met", lambda x: x["pos"] == i), lambda x: x["value"]))
    sources = F.transform(F.sequence(F.lit(0), F.col("n_sources") - 1), at)
    joined = joined.withColumn("sources", sources).withColumns({"s0": F.get("sources", F.lit(0)), "s1": F.get("sources", F.lit(1))})
    w = W.by("entity_id", "component")
    raw = joined.withColumn("_raw", _dispatch({**COMBINE, **(combine or {})}, lambda fn: fn(), F.col("s0")))
    moved = raw.withColumn("_x", _dispatch({**CHANGE, **(change or {})}, lambda fn: fn("_raw", w), F.col("_raw")))
    return moved.select(*keys, "composite", (W.expanding_z("_x", w, Z_MIN) * F.col("sign")).alias("z"))


def composites(parts: DataFrame) -> DataFrame:
    """Equal-weight mean of the components present in a month."""
    return parts.groupBy("entity_id", "period_end", "composite").agg(F.avg("z").alias("value"))


def bands(levels: DataFrame) -> DataFrame:
    w = W.by("entity_id", "composite")
    return levels.withColumns({
        "low": W.rolling_quantile("value", 0.33, STATE_WINDOW, w, STATE_MIN),
        "high": W.rolling_quantile("value", 0.67, STATE_WINDOW, w, STATE_MIN),
    })


def states(levels: DataFrame) -> DataFrame:
    return bands(levels).withColumn("state", W.tertile_state("value", "low", "high")).drop("low", "high")


def build(panel: DataFrame, spec: DataFrame) -> dict[str, DataFrame]:
    parts = components(panel, spec)
    levels = composites(parts)
    return {"components": parts, "composites": levels, "states": states(levels)}


def kpis(state_rows: DataFrame) -> DataFrame:
    """Latest value, change against three months earlier and latest state per composite."""
    from pyspark.sql import Window

    whole = Window.partitionBy("entity_id", "composite")
    last = F.max(F.when(F.col("value").isNotNull(), F.col("period_end"))).over(whole)
    earlier = W.last_known("value", upto=F.last_day(F.add_months(F.col("_last"), -3)))
    return state_rows.withColumn("_last", last).groupBy("entity_id", "composite").agg(
        W.last_known("value").alias("latest"), (W.last_known("value") - earlier).alias("delta_3m"), W.last_known("state").alias("state"))


def drill_down(parts: DataFrame, spec: DataFrame) -> DataFrame:
    """Latest score of each component, its share of the composite by registered members, and direction."""
    members = spec.groupBy("composite").agg(F.count(F.lit(1)).alias("n_members"))
    latest = parts.groupBy("entity_id", "composite", "component").agg(W.last_known("z").alias("z"))
    return latest.join(members, "composite").select(
        "entity_id", "composite", "component", "z", (F.col("z") / F.col("n_members")).alias("contribution"),
        F.when(F.col("z") > 0, "up").when(F.col("z").isNotNull(), "down").otherwise("none").alias("direction"))
