"""Checks on live scores and features, and their roll-up to alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import calibration as C

LIMITS = {"volatility": 0.15, "last_change": 0.10, "spread": 0.30, "psi": 0.20, "gap": 0.15, "ece": 0.10, "slope_low": 0.5, "slope_high": 1.5, "stale_days": 45}


def stability(scores: DataFrame, keys: list[str], window: int = 6) -> DataFrame:
    """Rolling deviation of the score: now, on average, at most; and the last monthly change."""
    w = W.by(*keys)
    df = scores.withColumns({"_v": W.rolling_std("prob", window, w), "_d": F.abs(W.diff("prob", 1, w))})
    return df.groupBy(*keys).agg(
        F.max_by("_v", "period_end").alias("current_vol"), F.avg("_v").alias("mean_vol"), F.max("_v").alias("max_vol"), F.max_by("_d", "period_end").alias("last_change"))


def disagreement(members: DataFrame, keys: list[str]) -> DataFrame:
    """Member spread at the latest month against its history (a few hundred months per key)."""
    monthly = members.groupBy(*keys, "period_end").agg((F.max("prob") - F.min("prob")).alias("spread"), F.stddev_samp("prob").alias("std"))
    return monthly.groupBy(*keys).agg(
        F.max_by("spread", "period_end").alias("current_spread"), F.max_by("std", "period_end").alias("current_std"),
        F.avg("spread").alias("mean_spread"), F.percentile("spread", 0.95).alias("p95_spread"))


def drift_summary(psi: DataFrame, keys: list[str], limit: float = LIMITS["psi"], top: int = 5) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("psi").desc(), "feature")
    ranked = psi.withColumn("psi", F.round("psi", 4)).withColumn("_r", F.row_number().over(order))
    drifted = F.col("psi") > limit
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(drifted).alias("drifted"), F.round(F.avg("psi"), 4).alias("mean_psi"), F.max("psi").alias("max_psi"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(drifted & (F.col("_r") <= top), F.struct("_r", "feature")))), lambda x: x["feature"]), ",").alias("top_drifted"))


def last_rows(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("period_end").desc())
    return scores.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= k).drop("_r")


def calibration_gap(scores: DataFrame, keys: list[str], window: int = 24) -> DataFrame:
    """Mean score over the last months against the event rate of those with a known label."""
    out = last_rows(scores, keys, window).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), F.avg("prob").alias("mean_predicted"), F.avg("y").alias("observed_rate"), F.count("y").alias("observed_months"))
    return out.where(F.col("months") >= window).withColumn("gap", F.abs(F.col("mean_predicted") - F.col("observed_rate")))


def calibration_quality(scores: DataFrame, keys: list[str], window: int = 60, minimum: int = 12) -> DataFrame:
    """ECE, slope and Brier parts of the last labelled months; short or one-class keys are skipped."""
    recent = last_rows(scores.where("y is not null and prob is not null"), keys, window)
    good = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.countDistinct("y").alias("_k")).where(f"months >= {minimum} and _k = 2").drop("_k")
    rows = recent.join(good.select(*keys), keys, "left_semi")
    return good.join(C.calibration_error(rows, keys).drop("n_samples"), keys).join(C.slope_intercept(rows, keys), keys, "left").join(C.brier_parts(rows, keys), keys)


def freshness(rows: DataFrame, keys: list[str], as_of: str, date: str = "period_end") -> DataFrame:
    """Age of the latest row against an explicit date, never the wall clock."""
    latest = rows.groupBy(*keys).agg(F.max(date).alias("latest"))
    return latest.withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "latest"))


def alerts(checks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per broken limit. Checks: stability, disagreement, drift, gap, quality, freshness."""
    rules = {
        "stability": [("WARNING", "volatility", F.col("current_vol") > LIMITS["volatility"]), ("WARNING", "large monthly change", F.col("last_change") > LIMITS["last_change"])],
        "disagreement": [("WARNING", "member spread", F.col("current_spread") > LIMITS["spread"])],
        "drift": [("WARNING", "feature drift", F.col("drifted") > 0)],
        "gap": [("INFO", "calibration gap", F.col("gap") > LIMITS["gap"])],
        "quality": [("WARNING", "calibration error", F.col("ece") > LIMITS["ece"]),
                    ("INFO", "calibration slope", (F.col("slope") < LIMITS["slope_low"]) | (F.col("slope") > LIMITS["slope_high"]))],
        "freshness": [("WARNING", "stale data", F.col("days_old") > LIMITS["stale_days"])],
    }
    parts = []
    for name, df in checks.items():
        hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, text, cond in rules[name]]))
        parts.append(df.select(*keys, F.lit(name).alias("check"), F.inline(hits)))
    return reduce(DataFrame.unionByName, parts)


def report(alert_rows: DataFrame, everyone: DataFrame, keys: list[str]) -> DataFrame:
    """Status per key: WARNING when anything fired."""
    counts = alert_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_alerts"))
    n = F.coalesce("n_alerts", F.lit(0))
    return everyone.join(counts, keys, "left").select(*keys, n.alias("n_alerts"), F.when(n > 0, "WARNING").otherwise("OK").alias("status"))
