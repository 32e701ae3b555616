"""Tables behind the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import risk_band, shift_months


def latest_score(scores: DataFrame, keys: list[str], start: str, end: str, horizon: int) -> DataFrame:
    """Latest row of the range and horizon (the largest available if the asked one is absent), with its band."""
    ranged = scores.where(F.col("period_end").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    per = Window.partitionBy(*keys)
    asked = F.max(F.when(F.col("horizon") == horizon, F.col("horizon"))).over(per)
    picked = ranged.withColumn("_h", F.coalesce(asked, F.max("horizon").over(per))).where("horizon = _h")
    last = picked.groupBy(*keys, "horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("period_end", "prob", "ci_lower", "ci_upper")).alias("x"))
    return last.select(*keys, "horizon", "n_rows", "x.period_end", "x.prob", "x.ci_lower", "x.ci_upper", risk_band("x.prob").alias("band"))


def peer_comparison(scores: DataFrame, peers: DataFrame, keys: list[str]) -> DataFrame:
    """Latest known value of each peer against the latest score."""
    own = scores.groupBy(*keys).agg(W.last_known("prob").alias("own"))
    other = peers.groupBy(*keys, "series_id").agg(W.last_known("value").alias("peer"))
    return other.join(own, keys).withColumn("difference", F.col("own") - F.col("peer"))


def indicator_summary(panel: DataFrame, periods: int = 11) -> DataFrame:
    """Current value, its month, and the change over ``periods`` known observations."""
    w = Window.partitionBy("entity_id", "series_id").orderBy(F.col("period_end").desc())
    ranked = panel.where("value is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r").isin(1, periods + 1))
    at = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    out = ranked.groupBy("entity_id", "series_id").agg(at(1, "value").alias("current"), at(1, "period_end").alias("as_of"), at(periods + 1, "value").alias("_b"))
    change: Column = F.col("current") - F.col("_b")
    return out.select("entity_id", "series_id", "current", "as_of", change.alias(f"change_{periods}"), F.try_divide(100.0 * change, F.abs("_b")).alias(f"change_{periods}_pct"))


def trend_slice(panel: DataFrame, as_of: str, months: int = 60) -> DataFrame:
    cut = shift_months(F.lit(as_of).cast("date"), -months)
    kept = panel.where((F.col("period_end") >= cut) & F.col("value").isNotNull())
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity_id", "series_id"))).where("_n > 1").drop("_n")


def indicator_statistics(panel: DataFrame, last: int = 12) -> DataFrame:
    """Mean, deviation, and the last rows as a list (bounded by ``last``)."""
    w = Window.partitionBy("entity_id", "series_id").orderBy(F.col("period_end").desc())
    ranked = panel.withColumn("_r", F.row_number().over(w))
    recent = F.sort_array(F.collect_list(F.when(F.col("_r") <= last, F.struct("period_end", "value"))))
    return ranked.groupBy("entity_id", "series_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), recent.alias("recent"))


def top_thresholds(sweep: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    r = lambda c: F.round(F.col(c), 9).desc()
    w = Window.partitionBy(*keys).orderBy(r("score"), r("precision"), r("specificity"), "threshold")
    return sweep.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def event_spans(flags: DataFrame) -> DataFrame:
    """Shaded spans: from each event's first month to one month after its last."""
    marked = W.with_islands(flags, F.col("flag"), W.by("entity_id"))
    spans = marked.where("flag = 1.0").groupBy("entity_id", "island").agg(F.min("period_end").alias("span_start"), F.max("period_end").alias("_z"))
    return spans.select("entity_id", "span_start", shift_months("_z", 1).alias("span_end"))


def with_derived(features: DataFrame, indicator: str) -> DataFrame:
    return features.where(F.startswith("feature", F.lit(indicator)))
