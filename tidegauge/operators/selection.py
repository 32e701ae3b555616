"""Feature ranking, distribution drift, redundancy pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import keyed_lasso
from tidegauge.operators.labels import class_weights
from tidegauge.session import durable
from tidegauge.sources import catalog

REDUNDANT = 0.92
DRIFT_FREE = 0.2
PRUNE_PSI = 9.0


def dense_enough(features: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Features with more than ``share`` known values."""
    return features.groupBy(*keys, "feature").agg((F.count("value") / F.count(F.lit(1))).alias("known_share")).where(F.col("known_share") > share)


def label_correlation(features: DataFrame, labels: DataFrame, keys: list[str], minimum: int = 100) -> DataFrame:
    """Absolute correlation with the label per feature, from mergeable moments; constant features drop out."""
    joined = features.join(labels.select("entity_id", "period_end", "y"), ["entity_id", "period_end"]).where("value is not null and y is not null")
    stats = joined.groupBy(*keys, "feature").agg(F.abs(F.try_divide(F.covar_pop("value", "y"), F.stddev_pop("value") * F.stddev_pop("y"))).alias("abs_corr"), F.count(F.lit(1)).alias("n"))
    return stats.where((F.col("n") > minimum) & F.col("abs_corr").isNotNull() & ~F.isnan("abs_corr"))


def candidate_pool(ranked: DataFrame, keys: list[str], max_features: int) -> DataFrame:
    """Top of the correlation ranking with its rank score 2 / rank."""
    order = Window.partitionBy(*keys).orderBy(F.round("abs_corr", 9).desc(), "feature")
    size = max(4 * max_features, max_features + 20)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).withColumn("score", F.lit(2.0) / F.col("rank"))


def feature_matrix(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Wide labelled rows, gaps carried forward within an entity and then set to 0."""
    wide = features.where(F.col("feature").isin(names)).groupBy("entity_id", "period_end").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])
    w = W.by("entity_id")
    filled = wide.select("entity_id", "period_end", *[F.coalesce(W.ffill(n, w), F.lit(0.0)).alias(n) for n in names])
    rows = filled.join(labels.select("entity_id", "period_end", "y"), ["entity_id", "period_end"]).where("y is not null")
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("entity_id", "period_end", "y", "features")


def _importance_rows(spark, names: list[str], values, model: str) -> DataFrame:
    rows = [(model, n, float(v)) for n, v in zip(names, values)]
    return catalog.dimension(spark, rows, "model STRING, feature STRING, importance DOUBLE")


def rank_scores(importance: DataFrame, base: float, weight: float, top: int, positive: bool = False) -> DataFrame:
    kept = importance.where("importance > 1e-6") if positive else importance
    order = Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("score", F.lit(weight * base) / F.col("rank"))


def _usable(rows: DataFrame, minimum: int = 80) -> bool:
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).first()
    return stats["n"] >= minimum and stats["k"] == 2


def forest_importance(rows: DataFrame, names: list[str], trees: int = 150, depth: int = 6, leaf: int = 5, seed: int = 42) -> DataFrame:
    weighted = class_weights(rows.withColumn("_k", F.lit(1)), ["_k"])
    model = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(weighted)
    return _importance_rows(rows.sparkSession, names, model.featureImportances.toArray(), "forest")


def recent_half(rows: DataFrame, limit: int = 500, minimum: int = 120) -> DataFrame:
    """The later part of each entity's last ``limit`` labelled rows."""
    w = Window.partitionBy("entity_id")
    df = rows.withColumns({"_r": F.row_number().over(w.orderBy(F.col("period_end").desc())), "_n": F.least(F.count(F.lit(1)).over(w), F.lit(limit))})
    return df.where(F.col("_r") <= F.least(F.col("_n"), F.greatest(F.lit(minimum), F.floor(F.col("_n") / 2)))).drop("_r", "_n")


def model_rank_scores(rows: DataFrame, names: list[str], max_features: int, kinds=("forest",)) -> DataFrame:
    """Rank scores of the forest on all rows (weight 1) and on the recent half (weight 0.75); thin or one-class windows add nothing."""
    rows = durable(rows)
    parts = []
    for weight, window in ((1.0, rows), (0.75, recent_half(rows))):
        if not _usable(window):
            continue
        if "forest" in kinds:
            parts.append(rank_scores(forest_importance(window, names), 1.5, weight, 2 * max_features).withColumn("window_weight", F.lit(weight)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- drift -----------------------------------------------------------------------

PSI_SELECTOR = {"recent": 12, "reference": 36, "smooth": 0.0}
PSI_MONITOR = {"recent": 12, "reference": 24, "smooth": 1e-4}


def psi(features: DataFrame, keys: list[str], recent: int, reference: int, smooth: float, bins: int = 10) -> DataFrame:
    """Population stability index of the last months against the months before.

    A group is one feature of one entity and holds at most ``recent + reference`` rows, so
    its histogram is worked out with array functions in the same aggregation.
    """
    newest = Window.partitionBy(*keys, "feature").orderBy(F.col("period_end").desc())
    whole = Window.partitionBy(*keys, "feature")
    tail = features.withColumns({"_r": F.row_number().over(newest), "_n": F.count(F.lit(1)).over(whole)}).where(
        (F.col("_r") <= recent + reference) & (F.col("_n") >= recent + reference) & F.col("value").isNotNull())
    v = F.round("value", 9)
    is_recent = F.col("_r") <= recent
    grouped = tail.groupBy(*keys, "feature").agg(
        F.percentile(F.when(~is_recent, F.col("value")), F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_q"),
        F.collect_list(F.when(~is_recent, v)).alias("_ref"), F.collect_list(F.when(is_recent, v)).alias("_rec"))
    usable = grouped.where((F.size("_ref") >= 10) & (F.size("_rec") >= 5)).withColumn("_e", F.array_distinct(F.transform("_q", lambda e: F.round(e, 9))))

    def histogram(values: str):
        last = F.size("_e") - 2
        edge = lambda i: F.get("_e", i)
        inside = lambda i: F.size(F.filter(values, lambda x: (x >= edge(i)) & ((x < edge(i + 1)) | ((i == last) & (x == edge(i + 1))))))
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: inside(i).cast("double"))

    counted = usable.withColumns({"_a": histogram("_ref"), "_b": histogram("_rec")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def share(c: str):
        if smooth:
            return F.transform(c, lambda x: (x + smooth) / (total(c) + smooth * F.size(c)))
        return F.transform(c, lambda x: F.greatest(x / F.greatest(total(c), F.lit(1.0)), F.lit(1e-6)))

    pairs = counted.withColumn("_z", F.zip_with(share("_a"), share("_b"), lambda p, q: (q - p) * F.ln(q / p)))
    value = F.when(F.size("_e") < 3, 0.0).otherwise(total(F.col("_z")))
    return pairs.select(*keys, "feature", (F.greatest(F.lit(0.0), value) if smooth else value).alias("psi"))


def drift_penalty(scores: DataFrame, drift: DataFrame, keys: list[str], strength: float = 0.0, severe: float | None = None) -> DataFrame:
    joined = scores.join(drift, [*keys, "feature"], "left")
    excess = F.greatest(F.lit(0.0), F.coalesce("psi", F.lit(0.0)) - DRIFT_FREE)
    out = joined.withColumn("score", F.col("score") - strength * F.log1p(excess))
    bad = F.lit(False) if severe is None else F.coalesce(F.col("psi") >= severe, F.lit(False))
    return out.withColumns({"severe": bad, "prunable": F.coalesce(F.col("psi") >= PRUNE_PSI, F.lit(False))})


# ---- redundancy --------------------------------------------------------------------


def carried(features: DataFrame, pool: DataFrame) -> DataFrame:
    """(entity_id, feature, rank, period_end, value): the pool's values with gaps carried forward."""
    w = Window.partitionBy("entity_id", "feature").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    rows = features.join(pool.select("entity_id", "feature", "rank"), ["entity_id", "feature"])
    return rows.select("entity_id", "feature", "rank", "period_end", F.last("value", ignorenulls=True).over(w).alias("value"))


def pool_correlation(features: DataFrame, pool: DataFrame) -> DataFrame:
    """(entity_id, feature, other, abs_corr, n) for every pair of an entity's candidates, over months in which both have a value.

    Candidates meet by entity and month, at most the pool of one entity at a time, and pairs are added up before they are shuffled.
    """
    rows = durable(carried(features, pool).where("value is not null"))
    left = rows.select("entity_id", "period_end", "feature", F.col("value").alias("_a"))
    right = rows.select("entity_id", "period_end", F.col("feature").alias("other"), F.col("value").alias("_b"))
    spread = (F.stddev_pop("_a") > 1e-9) & (F.stddev_pop("_b") > 1e-9)
    # F.corr divides by zero where a side is constant, whatever stands around it
    corr = F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))
    pairs = left.join(right, ["entity_id", "period_end"]).where("feature < other")
    return pairs.groupBy("entity_id", "feature", "other").agg(F.when(spread, F.abs(corr)).alias("abs_corr"), F.count(F.lit(1)).alias("n"))


def pool_vectors(features: DataFrame, labels: DataFrame, pool: DataFrame, width: int) -> DataFrame:
    """(entity_id, period_end, x, y): labelled rows with an entity's candidates in the order of their rank, gaps 0."""
    packed = carried(features, pool).groupBy("entity_id", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    x = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda r: F.coalesce(F.col("m")[r], F.lit(0.0)))
    return packed.select("entity_id", "period_end", x.alias("x")).join(labels.select("entity_id", "period_end", "y"), ["entity_id", "period_end"]).where("y is not null")


def sparse_rank_scores(features: DataFrame, labels: DataFrame, pool: DataFrame, max_features: int, width: int, C: float = 0.08, minimum: int = 60) -> DataFrame:
    """Rank scores of the L1 logistic of every entity on its own candidates, on all rows (weight 1) and on the later half (weight 0.75).

    All entities and windows are fitted in the same jobs. Thin or one-class windows add nothing.
    """
    keys = ["entity_id", "window_weight"]
    rows = durable(pool_vectors(features, labels, pool, width))
    both = rows.withColumn("window_weight", F.lit(1.0)).unionByName(recent_half(rows).withColumn("window_weight", F.lit(0.75)))
    enough = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= minimum).select(*keys)
    scaled = keyed_lasso.standardised(class_weights(both.join(enough, keys), keys), keys, width)
    fitted = keyed_lasso.fit(scaled, keys, width, C=C, weight="weight", most_steps=100)
    found = fitted.select(*keys, "converged", F.posexplode("coef").alias("rank", "_b")).where("rank > 0 and abs(_b) > 1e-6")
    named = found.join(pool.select("entity_id", "rank", "feature"), ["entity_id", "rank"]).withColumn("importance", F.abs("_b")).drop("rank", "_b")
    order = Window.partitionBy(*keys).orderBy(F.round("importance", 9).desc(), "feature")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * max_features)
    return ranked.withColumn("score", F.col("window_weight") * 2.0 / F.col("rank"))


def greedy_select(names: list[str], corr: np.ndarray, max_features: int, severe: set[str] = frozenset(), required: list[str] = (), available: set[str] = frozenset()) -> list[str]:
    """Walk the ranking, skip what repeats a chosen feature, refill, then make room for required names."""
    position = {n: i for i, n in enumerate(names)}
    chosen: list[str] = []

    def free() -> bool:
        return len(chosen) < max_features

    for name in names:
        if free() and name not in severe:
            rivals = [position[c] for c in chosen]
            if not rivals or not np.any(corr[position[name], rivals] > REDUNDANT):
                chosen.append(name)
    for allowed in (lambda n: n not in severe, lambda n: True):
        chosen += [n for n in names if n not in chosen and allowed(n)][: max(0, max_features - len(chosen))]
    kept: set[str] = set()
    for name in required:
        if name in severe or name not in available:
            continue
        if name not in chosen:
            if free():
                chosen.append(name)
            else:
                open_slots = [c for c in chosen if c not in kept]
                if not open_slots:
                    continue
                worst = max(open_slots, key=lambda c: position.get(c, len(names)))
                chosen[chosen.index(worst)] = name
        kept.add(name)
    return chosen


def select_features(ranked: DataFrame, features: DataFrame, max_features: int, required: list[str] = ()) -> DataFrame:
    """Final selection per entity.

    ``ranked`` holds (entity_id, feature, score, severe). The value rows of the candidates
    meet in one group per entity: its size is months x candidate pool, both bounded, and
    entities run in parallel. Required names outside the pool are only checked for presence.
    """
    wanted = F.col("feature").isin(list(required))
    pool = ranked.select("entity_id", "feature", F.round("score", 12).alias("score"), "severe")
    values = features.join(pool, ["entity_id", "feature"], "left").where(F.col("score").isNotNull() | wanted).select(
        "entity_id", "feature", "period_end", "value", "score", "severe")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        info = pdf.drop_duplicates("feature").dropna(subset=["score"]).sort_values(["score", "feature"], ascending=[False, True])
        names = info["feature"].tolist()
        wide = pdf[pdf["feature"].isin(names)].pivot(index="period_end", columns="feature", values="value").sort_index().ffill()
        corr = wide.reindex(columns=names).corr().abs().fillna(0.0).to_numpy()
        severe = set(info.loc[info["severe"].fillna(False).astype(bool), "feature"])
        picked = greedy_select(names, corr, max_features, severe, list(required), set(pdf["feature"]))
        return pd.DataFrame({"entity_id": pdf["entity_id"].iloc[0], "feature": picked, "rank": range(1, len(picked) + 1)})

    return values.groupBy("entity_id").applyInPandas(one, "entity_id STRING, feature STRING, rank INT")


def binned_information(features: DataFrame, labels: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mutual information of equal-count bins with the label, per feature."""
    joined = features.join(labels.select("entity_id", "period_end", "y"), ["entity_id", "period_end"]).where("value is not null and y is not null")
    order = Window.partitionBy(*keys, "feature").orderBy(F.round("value", 9), "period_end")
    cells = joined.withColumn("bin", F.ntile(bins).over(order)).groupBy(*keys, "feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    per = lambda *k: F.sum("c").over(Window.partitionBy(*keys, "feature", *k))
    n = per()
    terms = cells.withColumn("t", F.col("c") / n * F.ln(F.col("c") * n / (per("bin") * per("y"))))
    return terms.groupBy(*keys, "feature").agg(F.sum("t").alias("information"))
