"""L1-penalised logistic regression for many keys at once.

A key is one fit (entity, window, fold, origin). One step is one aggregation of gradient, curvature and loss per key, added up
within tasks first, and a batch of small solves: the quadratic model with the L1 penalty is solved by coordinate descent
on the curvature matrix (a proximal Newton step). A step after which a key's objective rose is halved. The coefficient table is written after every step.

The objective is |b|_1 + C sum(weight * log loss); the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import durable


def descend(h: np.ndarray, grad: np.ndarray, old: np.ndarray, penalty: float, most: int = 2000, tolerance: float = 1e-11) -> np.ndarray:
    """The b that minimises 1/2 (b - old)' h (b - old) - grad' (b - old) + penalty |b[1:]|_1."""
    b, slope = old.copy(), grad.copy()  # slope = grad - h (b - old)
    for _ in range(most):
        moved = 0.0
        for j in range(len(b)):
            if h[j, j] <= 1e-12:
                continue
            z = slope[j] + h[j, j] * b[j]
            new = z / h[j, j] if j == 0 else np.sign(z) * max(abs(z) - penalty, 0.0) / h[j, j]
            if new != b[j]:
                slope -= h[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(h[j, j]))
                b[j] = new
        if moved <= tolerance * max(1.0, np.sqrt(np.abs(np.diag(h)).max())):
            break
    return b


def standardised(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows (keys, x, ...) with x scaled by the mean and deviation of its key; a feature without spread becomes 0."""
    entries = rows.select(*keys, F.posexplode("x").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = entries.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m", "s"))), lambda e: F.struct(e["m"].alias("m"), e["s"].alias("s"))).alias("_stats"))
    scaled = F.zip_with("x", "_stats", lambda v, e: F.when(e["s"] > 1e-12, (v - e["m"]) / e["s"]).otherwise(0.0))
    return rows.join(stats, keys).withColumn("x", scaled).drop("_stats")


def fit(rows: DataFrame, keys: list[str], width: int, C: float = 0.1, weight: str | None = None, most_steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(keys, coef, converged) with the intercept first, from labelled rows (keys, x, y). One-class keys have no row."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = durable(rows.where(F.col("y").isNotNull()).select(*keys, "x", F.col("y").cast("double").alias("y"), w.alias("w")))
    k = width + 1
    upper = np.triu_indices(k)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*keys).schema.fields)
    zero = F.array_repeat(F.lit(0.0), k)
    state = data.groupBy(*keys).agg(F.min("y").alias("_a"), F.max("y").alias("_b")).where("_a < _b").select(
        *keys, zero.alias("coef"), zero.alias("last"), F.lit(float("inf")).alias("objective"), F.lit(False).alias("converged"))
    state = durable(state)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                x = np.concatenate([np.ones((len(part), 1)), np.stack(part["x"].to_numpy())], axis=1)
                y, wt = part["y"].to_numpy(), part["w"].to_numpy()
                eta = x @ part["coef"].iloc[0]
                mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
                loss = (wt * (np.logaddexp(0.0, eta) - y * eta)).sum()
                own = np.concatenate([[loss], x.T @ (wt * (y - mu)), (x.T @ (x * (wt * np.maximum(mu * (1 - mu), 1e-10))[:, None]))[upper]])
                held[key] = held[key] + own if key in held else own
        for key, own in held.items():
            yield pd.DataFrame({**dict(zip(keys, ([v] * len(own) for v in key))), "i": np.arange(len(own), dtype=np.int32), "v": own})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for m, coef, last, before in zip(pdf["m"], pdf["coef"], pdf["last"], pdf["objective"]):
                m, coef, last = np.asarray(m, float), np.asarray(coef, float), np.asarray(last, float)
                objective = C * m[0] + np.abs(coef[1:]).sum()
                if objective > before + 1e-9 * max(1.0, abs(before)):
                    found.append(((coef + last) / 2, last, before, False))
                    continue
                h = np.zeros((k, k))
                h[upper] = m[1 + k :]
                h = h + np.triu(h, 1).T
                new = descend(C * h, C * m[1 : 1 + k], coef, 1.0)
                found.append((new, coef, objective, bool(np.abs(new - coef).max() <= tolerance * max(1.0, np.abs(coef).max()))))
            yield pdf[keys].reset_index(drop=True).join(pd.DataFrame(found, columns=["coef", "last", "objective", "converged"]))

    for _ in range(most_steps):
        waiting = state.where("not converged")
        if waiting.isEmpty():
            break
        sums = data.join(waiting.select(*keys, "coef"), keys).mapInPandas(add, f"{names}, i int, v double").groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        packed = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))
        moved = packed.join(waiting, keys).mapInPandas(step, f"{names}, coef array<double>, last array<double>, objective double, converged boolean")
        state = durable(state.where("converged").unionByName(moved))
    return state.select(*keys, "coef", "converged")


def score(rows: DataFrame, fitted: DataFrame, keys: list[str], name: str = "prob") -> DataFrame:
    """Probability of each row (x) under its key's fit; null where the key has none."""
    eta = F.aggregate(F.zip_with("x", F.slice("_c", 2, F.size("x")), lambda a, b: a * b), F.col("_c")[0], lambda s, v: s + v)
    return rows.join(fitted.select(*keys, F.col("coef").alias("_c")), keys, "left").withColumn(name, 1.0 / (1.0 + F.exp(-eta))).drop("_c")
