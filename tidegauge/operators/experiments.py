"""Verdicts over result tables, and keyed ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import keyed_logit

KEEP_MARGIN = 0.01


def fallback(primary: str, other: str) -> Column:
    return F.coalesce(primary, other)


def bake_off(results: DataFrame, keys: list[str], champion: str = "hybrid") -> DataFrame:
    """Winner by cross-validated PR-AUC and what to do about it.

    ``results`` holds one row per (keys, variant) with cv_pr_auc, test_pr_auc and detected.
    """
    r = results.withColumn("_s", F.round(F.coalesce("cv_pr_auc", "test_pr_auc"), 9))
    row = F.struct("variant", "_s", "test_pr_auc", "detected")
    order = F.struct(F.coalesce("_s", F.lit(-1.0)).alias("s"), (F.col("variant") == champion).cast("int").alias("c"), "variant")
    out = r.groupBy(*keys).agg(F.max_by(row, order).alias("w"), F.max(F.when(F.col("variant") == champion, row)).alias("h"))
    margin = F.when(F.col("w.variant") == champion, 0.0).otherwise(F.coalesce(F.col("w._s") - F.col("h._s"), F.lit(0.0)))
    regression = F.coalesce(F.col("h.test_pr_auc") - F.col("w.test_pr_auc"), F.lit(0.0))
    wins, parity = F.col("margin") >= KEEP_MARGIN, F.col("w.detected") >= F.col("h.detected")
    verdict = (
        F.when(F.col("h").isNull(), "NEEDS-WORK").when(F.col("w.variant") == champion, "DISCARD")
        .when(wins & parity & (regression <= 0.01), "KEEP").when(wins, "NEEDS-WORK").otherwise("DISCARD"))
    return out.withColumn("margin", margin).select(*keys, F.col("w.variant").alias("winner"), "margin", verdict.alias("verdict"))


def ablation(rows: DataFrame, keys: list[str], features: list[str], train: Column, baseline: str = "none") -> DataFrame:
    """Score the test rows once with everything and once with each feature set to zero; the dropped feature is a key."""
    which = F.explode(F.array(*[F.lit(f) for f in [baseline, *features]])).alias("ablated")
    wide = rows.select("*", which)
    zeroed = wide.withColumns({f: F.when(F.col("ablated") == f, 0.0).otherwise(F.col(f)) for f in features})
    group = [*keys, "ablated"]
    scaled = keyed_logit.standardise(zeroed, group, features, train)
    coef = keyed_logit.fit(scaled.where(train), group, features)
    return keyed_logit.score(scaled.where(~train), coef, group, features)


def member_addition(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keep a new member when it lifts the key event's peak, earns weight and helps, or lifts the mean AUC."""
    b = before.select(*keys, F.col("peak").alias("b_peak"), F.col("mean_auc").alias("b_auc"))
    df = after.join(b, keys).withColumns({"peak_delta": F.col("peak") - F.col("b_peak"), "auc_delta": F.col("mean_auc") - F.col("b_auc")})
    keep = (F.col("peak_delta") >= 0.03) | ((F.col("weight") >= 0.05) & (F.col("loo_brier_delta") > 0)) | ((F.col("auc_delta") >= 0.01) & (F.col("detected") >= 4))
    drop = (F.col("weight") <= 0) & (F.coalesce(F.abs("peak_delta"), F.lit(0.0)) < 0.01)
    return df.withColumn("verdict", F.when(F.coalesce(keep, F.lit(False)), "KEEP").when(drop, "DISCARD").otherwise("NEEDS-WORK"))


GATES = {
    "pr_auc_within_5pct": lambda: F.col("d_pr_auc_pct") >= -5.0,
    "auc_ge_0_90": lambda: F.col("mean_auc") >= 0.90,
    "ece_le_0_10": lambda: F.col("best_ece") <= 0.10,
    "ece_not_regressed": lambda: F.col("best_ece") <= F.col("reference_ece") * 1.1,
    "raw_ece_le_0_10": lambda: F.col("raw_ece") <= 0.10,
    "coverage_ge_85pct": lambda: F.col("coverage") >= 0.85,
    "five_detected": lambda: F.col("detected") >= 5,
    "key_peak_ge_0_33": lambda: F.col("key_peak") >= 0.33,
}


def upgrade_gates(table: DataFrame) -> DataFrame:
    """Named boolean gates of a calibration upgrade and the verdict; unknown inputs fail their gate."""
    gated = table.withColumns({name: F.coalesce(rule(), F.lit(False)) for name, rule in GATES.items()})
    keep = (F.col("ece_le_0_10") | F.col("ece_not_regressed")) & F.col("coverage_ge_85pct") & F.col("five_detected") & F.col("auc_ge_0_90")
    drop = F.coalesce((F.col("d_pr_auc_pct") <= -15.0) | (F.col("best_ece") > F.col("reference_ece") * 1.5), F.lit(False)) | (F.col("detected") == 0)
    return gated.withColumn("verdict", F.when(drop, "DISCARD").when(keep, "KEEP").otherwise("NEEDS-WORK"))


def frozen_rescore(rows: DataFrame, weights: dict[str, float], keys: list[str], last: int = 134) -> DataFrame:
    """The last labelled rows scored with a frozen model's members and weights."""
    w = Window.partitionBy(*keys).orderBy(F.col("period_end").desc())
    recent = rows.where("y is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    blend = sum((F.lit(v) * F.col(m) for m, v in weights.items()), F.lit(0.0))
    return recent.withColumn("prob", blend).drop("_r")
