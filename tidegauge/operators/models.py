"""Classifiers with pyspark.ml, the two-factor model, and the pooled regime model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import clip, row_mean
from tidegauge.operators import calibration, keyed_logit
from tidegauge.operators.labels import class_weights
from tidegauge.session import durable
from tidegauge.sources import catalog

SEED = 42


# ---- estimator factories: add a model by name ---------------------------------------


def logit_estimator(n: int, C: float = 0.1, max_iter: int = 100) -> Estimator:
    """L1 logistic; an inverse penalty C on summed loss is 1 / (C n) on mean loss."""
    return LogisticRegression(featuresCol="z", labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=1.0 / (C * n), standardization=False, maxIter=max_iter)


def forest_estimator(n: int, numTrees: int = 300, maxDepth: int = 8, minInstancesPerNode: int = 10) -> Estimator:
    return RandomForestClassifier(featuresCol="z", labelCol="y", weightCol="weight", numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=SEED)


def boost_estimator(n: int, maxIter: int = 400, stepSize: float = 0.01, maxDepth: int = 5, subsamplingRate: float = 0.8, featureSubsetStrategy: str = "0.7", minInstancesPerNode: int = 10) -> Estimator:
    return GBTClassifier(featuresCol="z", labelCol="y", weightCol="weight", maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, subsamplingRate=subsamplingRate,
                         featureSubsetStrategy=featureSubsetStrategy, minInstancesPerNode=minInstancesPerNode, seed=SEED)


ESTIMATORS: dict[str, Callable[..., Estimator]] = {"logit": logit_estimator, "forest": forest_estimator, "boost": boost_estimator}
WHOLE = {"numTrees", "maxDepth", "minInstancesPerNode", "maxIter"}


def candidate_params(config: dict[str, str], member: str) -> dict:
    """Keyword arguments of one member from a candidate's ``member.param`` entries."""
    own = {k.split(".", 1)[1]: v for k, v in config.items() if k.startswith(member + ".")}
    typed = lambda k, v: v if k == "featureSubsetStrategy" else int(v) if k in WHOLE else float(v)
    return {k: typed(k, v) for k, v in own.items()}


# ---- fit and score ---------------------------------------------------------------------


class Preparation:
    """Assembly, scaling by training statistics, and optional principal factors appended."""

    def __init__(self, train: DataFrame, features: list[str], factors: int = 0):
        self.assembler = VectorAssembler(inputCols=features, outputCol="v")
        vectors = self.assembler.transform(train)
        self.scaler = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="s").fit(vectors)
        self.names = list(features)
        self.pca = None
        if factors:
            k = min(factors, len(features))
            self.pca = PCA(k=k, inputCol="s", outputCol="p").fit(self.scaler.transform(vectors))
            self.names += [f"factor_{i + 1}" for i in range(k)]

    def apply(self, rows: DataFrame) -> DataFrame:
        out = self.scaler.transform(self.assembler.transform(rows))
        if self.pca is None:
            return out.withColumnRenamed("s", "z").drop("v")
        both = VectorAssembler(inputCols=["s", "p"], outputCol="z")
        return both.transform(self.pca.transform(out)).drop("v", "s", "p")


class Member:
    def __init__(self, name: str, train: DataFrame, features: list[str], factors: int = 0, **params):
        self.name, self.prep = name, Preparation(train, features, factors)
        prepared = class_weights(self.prep.apply(train).withColumn("_k", F.lit(1)), ["_k"]).persist()
        self.model = ESTIMATORS[name](prepared.count(), **params).fit(prepared)
        prepared.unpersist()

    def score(self, rows: DataFrame, name: str = "prob") -> DataFrame:
        out = self.model.transform(self.prep.apply(rows))
        return out.withColumn(name, vector_to_array("probability")[1]).drop("z", "rawPrediction", "probability", "prediction")

    def importance(self, spark) -> DataFrame:
        values = np.abs(self.model.coefficients.toArray()) if hasattr(self.model, "coefficients") else self.model.featureImportances.toArray()
        rows = [(self.name, n, float(v)) for n, v in zip(self.prep.names, values)]
        return catalog.dimension(spark, rows, "model STRING, feature STRING, importance DOUBLE")


def out_of_fold(folds: DataFrame, features: list[str], members: dict[str, dict], n_folds: int = 5, factors: int = 0) -> DataFrame:
    """Every member fitted on each fold's training part and scored on its test part.

    Folds and members are a fixed handful, so their fits are submitted one after another;
    each fit is distributed over the rows.
    """
    folds = durable(folds)
    parts = []
    for fold in range(n_folds):
        train, test = folds.where((F.col("fold") == fold) & (F.col("role") == "train")), folds.where((F.col("fold") == fold) & (F.col("role") == "test"))
        if train.agg(F.countDistinct("y").alias("k")).first()["k"] < 2:
            continue
        for name, params in members.items():
            scored = Member(name, train, features, factors, **params).score(test)
            parts.append(scored.select(F.lit(name).alias("model"), "fold", "entity_id", "period_end", "y", "prob"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_fitted(folds: DataFrame, target: DataFrame, features: list[str], member: str, n_folds: int = 5, **params) -> DataFrame:
    """Per fold a member and an isotonic map on its held-out part; the target gets the mean of the calibrated folds."""
    folds, target = durable(folds), durable(target)
    parts = []
    for fold in range(n_folds):
        train, test = folds.where((F.col("fold") == fold) & (F.col("role") == "train")), folds.where((F.col("fold") == fold) & (F.col("role") == "test"))
        model = Member(member, train, features, **params)
        parts.append(calibration.isotonic(model.score(test), model.score(target)).select("entity_id", "period_end", F.lit(fold).alias("fold"), "calibrated"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id", "period_end").agg(F.avg("calibrated").alias("prob"), F.count(F.lit(1)).alias("n_folds"))


# ---- two-factor interaction model --------------------------------------------------------


def two_factor(train: DataFrame, target: DataFrame, keys: list[str], slope: str, rate: str, minimum: int = 60, neutral: float = 0.05) -> DataFrame:
    """Logistic on slope, rate and their product, one fit per key in the same jobs.

    Keys with too few complete rows or one class get the neutral probability. Gaps in the
    target are carried forward before scoring.
    """
    names = ["_x1", "_x2", "_x3"]
    terms = lambda df: df.withColumns({"_x1": F.col(slope), "_x2": F.col(rate), "_x3": F.col(slope) * F.col(rate)})
    complete = terms(train).dropna(subset=[slope, rate, "y"])
    enough = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).where(f"n >= {minimum} and k = 2").select(*keys)
    fit_rows = complete.join(enough, keys, "left_semi").select(*keys, "y", *names, F.lit(True).alias("_train"))
    w = W.by(*keys)
    filled = target.withColumns({slope: W.ffill(slope, w), rate: W.ffill(rate, w)})
    goal = terms(filled).select(*keys, "period_end", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    stats = fit_rows.groupBy(*keys).agg(*[F.avg(n).alias(f"_m{n}") for n in names], *[(F.stddev_pop(n) + 1e-8).alias(f"_s{n}") for n in names])
    scale = lambda df: df.join(stats, keys).withColumns({n: (F.col(n) - F.col(f"_m{n}")) / F.col(f"_s{n}") for n in names})
    weighted = class_weights(scale(fit_rows), keys)
    coef = keyed_logit.fit(weighted, keys, names, weight="weight", l2=1.0)
    scored = keyed_logit.score(scale(goal), coef, keys, names).select(*keys, "period_end", clip("prob", 0.01, 0.99).alias("prob"))
    return goal.select(*keys, "period_end").join(scored, [*keys, "period_end"], "left").withColumn("prob", F.coalesce("prob", F.lit(neutral)))


def published_member(panel: DataFrame, scale: str = "scale", missing: float = 0.05) -> DataFrame:
    """A published probability series as an ensemble member."""
    unit = clip(F.coalesce(F.col("value") * F.col(scale), F.lit(missing)), 0.0, 1.0)
    return panel.withColumn("prob", clip(unit, 0.01, 0.99))


# ---- sign-aligned composite and regimes ----------------------------------------------------

COMPOSITE_SIGNS = {"leading_T10Y3M": 1, "NEAR_TERM_FORWARD_SPREAD": 1, "SAHM_INDICATOR": -1, "financial_NFCI": -1, "EBP_PROXY": -1, "CREDIT_STRESS_INDEX": -1}


def aligned_composite(rows: DataFrame, signs: dict[str, int], train: Column, keys: list[str] = ["entity_id"]) -> DataFrame:
    """Mean of sign-aligned scores with the key's training mean and deviation; gaps are skipped."""
    stats = rows.where(train).groupBy(*keys).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(signs)], *[(F.stddev_samp(c) + 1e-8).alias(f"_s{i}") for i, c in enumerate(signs)])
    parts = [sign * (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, (c, sign) in enumerate(signs.items())]
    return rows.join(stats, keys).withColumn("composite", row_mean(*parts)).drop(*[f"_{x}{i}" for i in range(len(signs)) for x in "ms"])


def pack_series(rows: DataFrame, value: str = "composite", keys: list[str] = ["entity_id"]) -> DataFrame:
    """One row per entity with its months in order: bounded by the length of a series."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period_end", F.coalesce(F.col(value), F.lit(0.0)).alias("x")))).alias("s"))


def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300


def _forward(b: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha, scale = np.empty_like(b), np.empty(len(b))
    prior = start
    for t in range(len(b)):
        joint = prior * b[t]
        scale[t] = joint.sum()
        alpha[t] = joint / scale[t]
        prior = alpha[t] @ move
    return alpha, scale


def fit_regimes(packed: DataFrame, k: int = 3, iterations: int = 50, tolerance: float = 1e-4) -> dict:
    """Gaussian switching model with constant transitions, parameters pooled over entities.

    An E-step runs per entity on its own packed series; only expected counts and moments
    are summed, and one row of them reaches the driver. Falls back to two regimes when one
    regime empties. ``converged`` says whether the likelihood settled within ``tolerance``;
    ``steps`` are those taken.
    """
    packed = durable(packed)
    moments = packed.select(F.explode("s.x").alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).first()
    spread = np.linspace(1.0, -1.0, k) * (moments["d"] or 1.0)
    par = {"mean": moments["m"] + spread, "var": np.full(k, (moments["d"] or 1.0) ** 2), "start": np.full(k, 1 / k), "move": np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))}
    last, converged, step = -np.inf, False, 0
    for step in range(1, iterations + 1):
        now = dict(par)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sums = np.zeros((k, 3)), np.zeros((k, k)), np.zeros(k), 0.0
                gamma_sums, moves, starts, loglik = sums
                for series in pdf["s"]:
                    x = np.array([r["x"] for r in series])
                    b = _densities(x, now["mean"], now["var"])
                    alpha, scale = _forward(b, now["start"], now["move"])
                    beta = np.ones_like(b)
                    for t in range(len(x) - 2, -1, -1):
                        beta[t] = now["move"] @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
                    gamma = alpha * beta
                    gamma /= gamma.sum(axis=1, keepdims=True)
                    for t in range(len(x) - 1):
                        moves += alpha[t][:, None] * now["move"] * (b[t + 1] * beta[t + 1]) / scale[t + 1]
                    gamma_sums += np.stack([gamma.sum(0), gamma.T @ x, gamma.T @ x**2], axis=1)
                    starts += gamma[0]
                    loglik += np.log(scale).sum()
                yield pd.DataFrame({"v": [np.concatenate([gamma_sums.ravel(), moves.ravel(), starts, [loglik]]).tolist()]})

        width = 3 * k + k * k + k + 1
        row = packed.select("s").mapInPandas(expect, "v ARRAY<DOUBLE>").agg(*[F.sum(F.col("v")[i]).alias(f"c{i}") for i in range(width)]).first()
        v = np.array(list(row))
        g, moves, starts, loglik = v[: 3 * k].reshape(k, 3), v[3 * k : 3 * k + k * k].reshape(k, k), v[3 * k + k * k : -1], v[-1]
        if k > 2 and g[:, 0].min() < 0.01 * g[:, 0].sum():
            return fit_regimes(packed, 2, iterations, tolerance)
        mean = g[:, 1] / g[:, 0]
        par = {"mean": mean, "var": np.maximum(g[:, 2] / g[:, 0] - mean**2, 1e-6), "start": starts / starts.sum(), "move": moves / moves.sum(axis=1, keepdims=True)}
        if converged := bool(abs(loglik - last) < tolerance * max(1.0, abs(loglik))):
            break
        last = loglik
    par |= {"loglik": float(loglik), "converged": converged, "steps": step}
    par["expansion"] = int(np.argmax(par["mean"]))
    return par


def regime_probability(packed: DataFrame, par: dict, keys: list[str] = ["entity_id"]) -> DataFrame:
    """Filtered probability of any non-expansion regime under fixed parameters."""
    names = ", ".join(f"{k} STRING" for k in keys)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.array([r["x"] for r in row["s"]])
                alpha, _ = _forward(_densities(x, par["mean"], par["var"]), par["start"], par["move"])
                yield pd.DataFrame({**{k: row[k] for k in keys}, "period_end": [r["period_end"] for r in row["s"]], "prob": 1.0 - alpha[:, par["expansion"]]})

    return packed.mapInPandas(apply, f"{names}, period_end DATE, prob DOUBLE")


def regime_table(spark, par: dict) -> DataFrame:
    rows = [(i, float(par["mean"][i]), float(par["var"][i]), float(par["move"][i, i]), bool(i == par["expansion"]), par["converged"]) for i in np.argsort(-par["mean"])]
    return catalog.dimension(spark, [(int(a), *r) for a, *r in rows], "regime INT, mean DOUBLE, variance DOUBLE, stay DOUBLE, is_expansion BOOLEAN, converged BOOLEAN")
