"""Penalised logistic regression for many keys at once.

A key is whatever distinguishes one fit from another: origin, scenario, candidate,
ablated feature. One Newton step is one aggregation of gradient and curvature sums per
key (partial sums before the shuffle, so a large key costs no more than a small one) and
a batch of small linear solves. The coefficient table is cut from its lineage after
every step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import sigmoid
from tidegauge.session import durable


def _linear(features: list[str]) -> Column:
    out = F.col("_c")[0]
    for i, f in enumerate(features):
        out = out + F.col("_c")[i + 1] * F.col(f)
    return out


def fit(rows: DataFrame, keys: list[str], features: list[str], y: str = "y", weight: str | None = None,
        l2: float | str = 1.0, most_steps: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """Coefficients per key as the array ``coef`` (intercept first). One-class keys have no row.

    ``l2`` is a number or a column that is constant per key; the intercept is not penalised.
    Newton steps, halved while they are over 5, go on until the largest is within the tolerance; ``converged`` says so per key.
    """
    strength = F.col(l2) if isinstance(l2, str) else F.lit(float(l2))
    w = F.col(weight) if weight else F.lit(1.0)
    data = durable(rows.where(F.col(y).isNotNull()).select(*keys, *features, F.col(y).alias("_y"), w.alias("_w"), strength.alias("_l2")))
    k = len(features) + 1
    zero = F.array(*[F.lit(0.0)] * k)
    coef = data.groupBy(*keys).agg(F.min("_y").alias("_a"), F.max("_y").alias("_b")).where("_a < _b").select(*keys, zero.alias("_c"))
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*keys).schema.fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            g = np.stack(pdf["_g"].to_numpy())
            h = np.zeros((len(pdf), k, k))
            flat = np.stack(pdf["_h"].to_numpy())
            for n, (i, j) in enumerate(pairs):
                h[:, i, j] = h[:, j, i] = flat[:, n]
            ridge = np.zeros((len(pdf), k, k))
            idx = np.arange(1, k)
            ridge[:, idx, idx] = pdf["_l2"].to_numpy()[:, None]
            old = np.stack(pdf["_c"].to_numpy())
            grad = g - np.einsum("nij,nj->ni", ridge, old)
            step = np.linalg.solve(h + ridge + 1e-9 * np.eye(k), grad[..., None])[..., 0]
            size = np.abs(step).max(axis=1)
            shrink = 0.5 ** np.ceil(np.log2(np.maximum(size / 5.0, 1.0)))
            yield pdf[keys].assign(_c=list(old + shrink[:, None] * step), converged=size <= tolerance * np.maximum(1.0, np.abs(old).max(axis=1)))

    for _ in range(most_steps):
        mu = sigmoid(_linear(features))
        joined = data.join(coef.select(*keys, "_c"), keys).withColumn("_mu", mu)
        r, v = F.col("_w") * (F.col("_y") - F.col("_mu")), F.col("_w") * F.col("_mu") * (1 - F.col("_mu"))
        sums = joined.groupBy(*keys).agg(
            F.first("_c").alias("_c"), F.max("_l2").alias("_l2"), F.array(*[F.sum(r * xi) for xi in x]).alias("_g"),
            F.array(*[F.sum(v * x[i] * x[j]) for i, j in pairs]).alias("_h"))
        coef = durable(sums.mapInPandas(solve, f"{names}, _c ARRAY<DOUBLE>, converged BOOLEAN"))
        if coef.where("not converged").isEmpty():
            break
    return coef.withColumnRenamed("_c", "coef")


def score(rows: DataFrame, coef: DataFrame, keys: list[str], features: list[str], name: str = "prob") -> DataFrame:
    """Probability per row under its key's fit; NULL where the key has no fit."""
    joined = rows.join(coef.select(*keys, F.col("coef").alias("_c")), keys, "left")
    return joined.withColumn(name, sigmoid(_linear(features))).drop("_c")


def standardise(rows: DataFrame, keys: list[str], features: list[str], train: Column) -> DataFrame:
    """Scale by the mean and population deviation of the key's training rows; gaps become 0."""
    stats = rows.where(train).groupBy(*keys).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    joined = rows.join(stats, keys)
    scaled = {f: F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")), F.lit(0.0)) for f in features}
    return joined.withColumns(scaled).drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])
