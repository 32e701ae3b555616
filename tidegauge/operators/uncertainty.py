"""Stationary bootstrap and probability bands, per entity and replicate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators.calibration import apply_sigmoid, slope_intercept


def hash_int(text: Column) -> Column:
    """32-bit integer from a string, the same in any engine: randomness that survives a retry."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bootstrap_indices(rows: DataFrame, replicates: int, block: int = 12, keys: list[str] = ["entity_id"], seed: int = 42) -> DataFrame:
    """Resampled row numbers of every replicate; ``rows`` carries ``rn`` (1..n) and ``n`` per key.

    A position restarts at a random row with probability 1/block, else it continues the
    block. Replicates are a key column; one window partition is one series of one
    replicate.
    """
    grid = rows.select(*keys, "rn", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    tag = lambda what: F.concat_ws("|", F.lit(str(seed)), F.lit(what), *keys, "replicate", "rn")
    restart = (F.col("rn") == 1) | (hash_int(tag("r")) % block == 0)
    df = grid.withColumn("_s", F.when(restart, F.struct("rn", (hash_int(tag("s")) % F.col("n")).alias("start"))))
    w = W.by(*keys, "replicate", order="rn")
    df = df.withColumn("_s", F.last("_s", True).over(W.expanding(w)))
    index = F.pmod(F.col("_s.start") + F.col("rn") - F.col("_s.rn"), F.col("n")) + 1
    return df.select(*keys, "replicate", F.col("rn").alias("position"), index.alias("rn"))


def bootstrap_interval(draws: DataFrame, values: DataFrame, keys: list[str], level: float = 0.90) -> DataFrame:
    """Mean, standard deviation and quantiles per row over the replicates that drew it (at most one list per row)."""
    tail = (1 - level) / 2
    joined = draws.join(values, [*keys, "rn"])
    return joined.groupBy(*keys, "rn").agg(
        F.avg("value").alias("boot_mean"), F.stddev_pop("value").alias("boot_std"),
        F.percentile("value", tail).alias("ci_lower"), F.percentile("value", 1 - tail).alias("ci_upper"))


def predictor_interval(draws: DataFrame, rows: DataFrame, keys: list[str], predict: Callable[[pd.DataFrame], np.ndarray], level: float = 0.90) -> DataFrame:
    """Any predictor: it sees one resampled series (one key, one replicate) and returns one value per row."""
    joined = draws.join(rows, [*keys, "rn"])
    schema = ", ".join(f"{k} STRING" for k in keys) + ", replicate INT, rn INT, value DOUBLE"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        return pdf[[*keys, "replicate", "rn"]].astype({"replicate": "int32", "rn": "int32"}).assign(value=np.asarray(predict(pdf), dtype=float))

    predicted = joined.groupBy(*keys, "replicate").applyInPandas(one, schema)
    tail = (1 - level) / 2
    return predicted.groupBy(*keys, "rn").agg(
        F.avg("value").alias("boot_mean"), F.stddev_pop("value").alias("boot_std"),
        F.percentile("value", tail).alias("ci_lower"), F.percentile("value", 1 - tail).alias("ci_upper"))


def calibrator_bootstrap(train: DataFrame, draws: DataFrame, test: DataFrame, keys: list[str], level: float = 0.90) -> DataFrame:
    """Refit the sigmoid on every replicate and score all test rows with each fit.

    A one-class replicate contributes the raw score.
    """
    resampled = draws.join(train.select(*keys, "rn", "prob", "y"), [*keys, "rn"])
    coef = slope_intercept(resampled, [*keys, "replicate"])
    all_reps = draws.select(*keys, "replicate").distinct().join(coef, [*keys, "replicate"], "left")
    packed = all_reps.groupBy(*keys).agg(F.collect_list(F.struct("replicate", "slope", "intercept")).alias("_fits"))
    x = F.ln(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prob"))))
    x = x - F.ln(1 - F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prob"))))
    spread = test.join(packed, keys).select(*test.columns, x.alias("_x"), F.inline("_fits"))
    scored = spread.withColumn("_p", F.coalesce(1 / (1 + F.exp(-(F.col("slope") * F.col("_x") + F.col("intercept")))), F.col("prob")))
    tail = (1 - level) / 2
    return scored.groupBy(*test.columns).agg(
        F.avg("_p").alias("boot_mean"), F.stddev_pop("_p").alias("boot_std"),
        F.percentile("_p", tail).alias("raw_lower"), F.percentile("_p", 1 - tail).alias("raw_upper"))


def final_band(rows: DataFrame, mean: str = "boot_mean", std: str = "boot_std", disagreement: str = "member_std", floor: float = 0.06) -> DataFrame:
    """Widest of percentile, normal and minimum-width bands, clipped to [0, 1] and re-expanded to the minimum width."""
    c = F.col
    wide = F.greatest(F.lit(floor), 2.0 * c(disagreement))
    lo = F.least(c("raw_lower"), c(mean) - 1.645 * c(std), c(mean) - wide / 2)
    hi = F.greatest(c("raw_upper"), c(mean) + 1.645 * c(std), c(mean) + wide / 2)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    df = rows.withColumns({"_w": wide, "_hi": unit(hi)}).withColumn("_lo", F.least(unit(lo), c("_hi")))
    missing = c("_w") - (c("_hi") - c("_lo"))
    short, at_low, at_high = missing > 0, c("_lo") <= 0.001, c("_hi") >= 0.999
    upper = F.when(short & at_low & ~at_high, F.least(c("_hi") + missing, F.lit(1.0))).when(short & ~at_low & ~at_high, F.least(c("_hi") + missing / 2, F.lit(1.0))).otherwise(c("_hi"))
    lower = F.when(short & at_high & ~at_low, F.greatest(c("_lo") - missing, F.lit(0.0))).when(short & ~at_low & ~at_high, F.greatest(c("_lo") - missing / 2, F.lit(0.0))).otherwise(c("_lo"))
    return df.withColumns({"ci_lower": lower, "ci_upper": upper}).drop("_w", "_lo", "_hi")


def dirichlet_draws(weights: dict[str, float], draws: int = 200, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).dirichlet([20 * w + 1 for w in weights.values()], size=draws)


def weight_perturbation(scores: DataFrame, weights: dict[str, float], row: list[str], draws: int = 200, level: float = 0.90, seed: int = 42) -> DataFrame:
    """Band from Dirichlet(20 w + 1) member weights; ``scores`` has one column per member.

    The draws are a fixed number of short vectors, made from the seed on the driver and
    shipped as a literal; the rows never leave their partition.
    """
    names = list(weights)
    sample = dirichlet_draws(weights, draws, seed)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in sample])
    values = F.transform(table, lambda w: sum((w[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0)))
    df = scores.select(*row, F.array_sort(values).alias("_v"))
    tail = (1 - level) / 2

    def quantile(q: float) -> Column:
        h = q * (draws - 1)
        i, f = int(h), h - int(h)
        a, b = F.col("_v")[i], F.col("_v")[min(i + 1, draws - 1)]
        return a + (b - a) * f

    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / draws
    var = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / draws
    return df.withColumn("_m", mean).select(*row, F.col("_m").alias("boot_mean"), F.sqrt(var).alias("boot_std"),
                                            quantile(tail).alias("ci_lower"), quantile(1 - tail).alias("ci_upper"))


def bootstrap_method(train: DataFrame, keys: list[str], block: int = 12) -> DataFrame:
    """Whether the block bootstrap has enough labelled history of both classes."""
    stats = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    reason = F.when(F.col("n") == 0, "no history").when(
        (F.col("n") < max(24, 2 * block)) | (F.col("p") == 0) | (F.col("p") == F.col("n")), "insufficient history")
    return stats.select(*keys, F.when(reason.isNull(), "block_bootstrap").otherwise("dirichlet").alias("method"), reason.alias("reason"))


def with_coverage(rows: DataFrame, keys: list[str], half: int = 6, min_width: float = 0.05) -> DataFrame:
    """Per row: is the band wide enough, and does it hold the score or the centred event rate?"""
    df = rows.withColumn("rate", W.centred_mean("y", half, W.by(*keys)))
    inside = lambda x: (F.col("ci_lower") <= F.col(x)) & (F.col(x) <= F.col("ci_upper"))
    return df.withColumns({"width": F.col("ci_upper") - F.col("ci_lower"), "has_mean": inside("prob"), "has_rate": inside("rate")}).withColumn(
        "covered", (F.col("width") >= min_width) & (F.col("has_mean") | F.col("has_rate")))


def coverage_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("width") >= 0.05).alias("wide_rows"), share("covered").alias("covered_share"),
        share("has_mean").alias("mean_share"), share("has_rate").alias("rate_share"), F.avg("width").alias("mean_width"),
        F.percentile("width", 0.5).alias("median_width"))


def numbered(rows: DataFrame, keys: list[str], order: str = "period_end") -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(order)), "n": F.count(F.lit(1)).over(w)})


__all__ = ["apply_sigmoid", "bootstrap_indices", "bootstrap_interval", "calibrator_bootstrap", "coverage_summary", "final_band",
           "hash_int", "numbered", "predictor_interval", "weight_perturbation", "with_coverage", "bootstrap_method"]
