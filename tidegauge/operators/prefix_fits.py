"""Fits of expanding training sets from sums by month.

A linear probability fit needs counts, sums and products of its training rows only. Those are added up once per month; running
sums over the months then give the training set of every origin, whatever the number of origins, and no row is copied.
Every candidate (how many features it keeps, how strongly it is penalised) is solved from the same sums. Rows that look different at each origin
(true vintages) are added up per origin instead and solved in the same way.

A fit: the features with the largest absolute correlation with the label (ties by order), standardised with the moments of the
training set, ridge-penalised as if by ``l2`` rows, intercept free. Its own threshold is the best of a sweep over its training scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import shift_months
from tidegauge.operators import ensemble

LOW, HIGH = 0.01, 0.99


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)


def scale_of(features: DataFrame) -> DataFrame:
    """(feature, at, by): the mean and deviation that bring the features to one size, so that products stay exact enough."""
    by = F.stddev_pop("value")
    return features.groupBy("feature").agg(F.avg("value").alias("at"), F.when(by > 0, by).otherwise(1.0).alias("by"))


def vectors(features: DataFrame, names: list[str], scale: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, entity_id, period_end, x): scaled values in the order of ``names``, gaps carried forward, then zero."""
    w = Window.partitionBy(*keys, "entity_id", "feature").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    filled = features.join(scale, "feature").withColumn("v", F.last((F.col("value") - F.col("at")) / F.col("by"), ignorenulls=True).over(w))
    found = filled.groupBy(*keys, "entity_id", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("m"))
    return found.select(*keys, "entity_id", "period_end", F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.col("m")[n], F.lit(0.0))).alias("x"))


def sums(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, i, v): sums of 1, y, x, x y and the products of x over labelled rows (x, y) of each key, added up within tasks first."""
    upper = np.triu_indices(width)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
                own = np.concatenate([[len(y), y.sum()], x.sum(0), x.T @ y, (x.T @ x)[upper]])
                held[key] = held[key] + own if key in held else own
        for key, own in held.items():
            yield pd.DataFrame({**dict(zip(keys, ([k] * len(own) for k in key))), "i": np.arange(len(own), dtype=np.int32), "v": own})

    parts = rows.where(F.col("y").isNotNull()).select(*keys, "x", F.col("y").cast("double").alias("y")).mapInPandas(add, f"{_ddl(rows, keys)}i int, v double")
    return parts.groupBy(*keys, "i").agg(F.sum("v").alias("v"))


def up_to(monthly: DataFrame, cuts: DataFrame, width: int, keys: list[str] = []) -> DataFrame:
    """(keys, cut, i, v): for every cut (keys, cut) the sums of all months up to it, from sums by (keys, period_end) of ``width`` features.

    Cuts are placed among the months by union and carry-forward, not by comparing each with each.
    """
    cells = 2 + 2 * width + width * (width + 1) // 2
    w = Window.partitionBy(*keys, "i").orderBy("period_end", "is_cut").rowsBetween(Window.unboundedPreceding, 0)
    every = F.sequence(F.lit(0), F.lit(cells - 1))
    wanted = cuts.select(*keys, F.col("cut").alias("period_end")).distinct().select(*keys, "period_end", F.explode(every).alias("i"), F.lit(0.0).alias("v"), F.lit(1).alias("is_cut"))
    both = monthly.select(*keys, "period_end", "i", "v", F.lit(0).alias("is_cut")).unionByName(wanted)
    return both.withColumn("v", F.sum("v").over(w)).where("is_cut = 1").select(*keys, F.col("period_end").alias("cut"), "i", "v")


def solve(n: float, sy: float, sx: np.ndarray, sxy: np.ndarray, sxx: np.ndarray, most: int, l2: float) -> tuple[float, np.ndarray]:
    """Intercept and one coefficient per feature (zero where it is not kept)."""
    mean, out = sx / n, np.zeros(len(sx))
    spread = np.sqrt(np.maximum(np.diag(sxx) / n - mean**2, 0.0))
    good = spread > 1e-9
    by = np.where(good, spread, 1.0)
    with_y = np.where(good, (sxy - sx * sy / n) / by, 0.0)
    kept = np.argsort(-np.round(np.abs(with_y) / n, 12), kind="stable")[:most]
    kept = np.sort(kept[good[kept]])
    gram = ((sxx - np.outer(sx, sx) / n) / np.outer(by, by))[np.ix_(kept, kept)]
    out[kept] = np.linalg.solve(gram + l2 * np.eye(len(kept)), with_y[kept]) / by[kept]
    return sy / n - float(out @ mean), out


FIT = "intercept double, coef array<double>, train_rows bigint, positives bigint, reason string"


def fits(cells: DataFrame, keys: list[str], candidates: list[tuple[str, int, float]], width: int, min_train: int = 180) -> DataFrame:
    """(keys, candidate_id, intercept, coef, train_rows, positives, reason) from the cells (keys, i, v) of each training set.

    ``candidates`` are (candidate_id, max_features, l2). Training sets that are short or of one class stay, with a reason and no coefficients.
    """
    packed = cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))
    each = [F.struct(F.lit(c).alias("candidate_id"), F.lit(most).alias("max_features"), F.lit(l2).alias("l2")) for c, most, l2 in candidates]
    asked = packed.select("*", F.inline(F.array(*each)))
    upper = np.triu_indices(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for m, most, l2 in zip(pdf["m"], pdf["max_features"], pdf["l2"]):
                m = np.asarray(m, float)
                n, sy = m[0], m[1]
                reason = "insufficient_history" if n < min_train else "one_class" if sy <= 0 or sy >= n else None
                intercept, coef = None, None
                if reason is None:
                    sxx = np.zeros((width, width))
                    sxx[upper] = m[2 + 2 * width :]
                    sxx = sxx + np.triu(sxx, 1).T
                    intercept, coef = solve(n, sy, m[2 : 2 + width], m[2 + width : 2 + 2 * width], sxx, int(most), float(l2))
                found.append((intercept, coef, int(round(n)), int(round(sy)), reason))
            columns = ["intercept", "coef", "train_rows", "positives", "reason"]
            yield pdf[[*keys, "candidate_id"]].reset_index(drop=True).join(pd.DataFrame(found, columns=columns))

    return asked.mapInPandas(run, f"{_ddl(cells, keys)}candidate_id string, {FIT}")


def scores(rows: DataFrame, fitted: DataFrame, on: list[str]) -> DataFrame:
    """Rows (x) with the fits that share ``on``: adds ``prob``, null without a fit."""
    joined = rows.join(fitted, on)
    columns = [c for c in joined.columns if c not in ("x", "coef", "intercept")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            prob = pd.Series(np.nan, index=pdf.index)
            has = pdf["coef"].notna().to_numpy()
            if has.any():
                part = pdf[has]
                raw = np.einsum("ij,ij->i", np.stack(part["x"].to_numpy()), np.stack(part["coef"].to_numpy())) + part["intercept"].to_numpy()
                prob[has] = np.clip(raw, LOW, HIGH)
            yield pdf[columns].assign(prob=prob.astype(object).where(prob.notna(), None).astype("Float64"))

    return joined.mapInPandas(run, f"{_ddl(joined, columns)}prob double")


def own_thresholds(train_scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the best of the sweep over the training scores of each fit."""
    return ensemble.choose_threshold(ensemble.threshold_sweep(train_scores, keys), keys).select(*keys, F.col("threshold"))


def training_months(origins: DataFrame, first: str, horizon: int, keys: list[str] = []) -> DataFrame:
    """(keys, origin, period_end) for every month whose label was known at the origin: scored rows meet their fits by month."""
    months = F.sequence(F.col(first), shift_months("origin", -horizon), F.expr("interval 1 month"))
    valid = F.col(first) <= shift_months("origin", -horizon)
    return origins.where(valid).select(*keys, "origin", F.explode(months).alias("m")).select(*keys, "origin", F.last_day("m").alias("period_end"))


def backtest(predict: DataFrame, fitted: DataFrame, thresholds: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:
    """One row per predicted row and candidate: actual, prob, the fit's own threshold, signal, training rows, reason.

    ``more`` names further columns of the predicted rows to keep.
    """
    scored = scores(predict, fitted, keys).join(thresholds, [*keys, "candidate_id"], "left")
    reason = F.coalesce("reason", F.when(F.col("y").isNull(), "label_unavailable"))
    return scored.select(
        *more, *keys, "candidate_id", "entity_id", "period_end", F.col("y").alias("actual"), "prob", "threshold",
        F.when(F.col("prob").isNotNull(), (F.col("prob") >= F.col("threshold")).cast("int")).alias("signal"), "train_rows", reason.alias("reason"))
