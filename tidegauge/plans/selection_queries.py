"""Feature ranking and drift (K01-K14), monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import features as X
from tidegauge.operators import monitor as M
from tidegauge.operators import selection as K
from tidegauge.plans import oracle_base as B
from tidegauge.plans.calibration_queries import brier_sql, ece_sql, newton_sql, reliability_sql
from tidegauge.plans.feature_queries import BLOCK, LAYER
from tidegauge.plans.metric_queries import r6
from tidegauge.plans.registry import query
from tidegauge.session import durable
from tidegauge.sources import catalog

MAX = 10
POOL = max(4 * MAX, MAX + 20)
EF = ["entity_id", "feature"]


def pool_features(t):
    """All engineered features that selection may use."""
    return X.engineer(t.macro).where(X.layer() != "meta")


def labels(t):
    return t.score_wide.select("entity_id", "period_end", "y")


B.add("pool", f"SELECT * FROM features_long WHERE {LAYER} <> 'meta'")
B.add("pool_y", "SELECT f.*, s.y FROM pool f JOIN score_wide s ON f.entity_id = s.entity_id AND f.period_end = s.period_end WHERE f.value IS NOT NULL AND s.y IS NOT NULL")


@query("k01_dense_enough", sql="SELECT entity_id, feature, ROUND(COUNT(value) / COUNT(*), 6) AS known_share FROM pool GROUP BY 1, 2 HAVING COUNT(value) / COUNT(*) > 0.7")
def k01(t):
    return K.dense_enough(pool_features(t), ["entity_id"]).select(*EF, F.round("known_share", 6).alias("known_share"))


B.add("corr_entity", """SELECT * FROM (SELECT entity_id, feature, ABS(CASE WHEN STDDEV_POP(value) > 0 AND STDDEV_POP(y) > 0 THEN CORR(value, y) END) AS abs_corr, COUNT(*) AS n FROM pool_y GROUP BY 1, 2)
 WHERE n > 60 AND abs_corr IS NOT NULL AND NOT isnan(abs_corr)""")


@query("k02_label_corr", sql="""SELECT feature, ROUND(abs_corr, 6) AS abs_corr, n FROM (SELECT feature, ABS(CASE WHEN STDDEV_POP(value) > 0 AND STDDEV_POP(y) > 0 THEN CORR(value, y) END) AS abs_corr, COUNT(*) AS n FROM pool_y GROUP BY 1)
 WHERE n > 100 AND abs_corr IS NOT NULL AND NOT isnan(abs_corr)""")
def k02(t):
    return K.label_correlation(pool_features(t), labels(t), []).select("feature", F.round("abs_corr", 6).alias("abs_corr"), "n")


def entity_pool(t, features=None):
    ranked = K.label_correlation(features or pool_features(t), labels(t), ["entity_id"], minimum=60)
    return K.candidate_pool(ranked, ["entity_id"], MAX)


B.add("entity_pool", f"""SELECT *, 2.0 / rank AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY ROUND(abs_corr, 9) DESC, feature) AS rank FROM corr_entity) WHERE rank <= {POOL}""")


@query("k03_candidate_pool", longs=("rank",), sql="SELECT entity_id, feature, rank, ROUND(score, 6) AS score FROM entity_pool")
def k03(t):
    return entity_pool(t).select(*EF, "rank", F.round("score", 6).alias("score"))


def top_names(t, features, k=40):
    """Names of the pooled candidates: at most ``k`` strings come to the driver."""
    ranked = K.candidate_pool(K.label_correlation(features, labels(t), []).withColumn("_k", F.lit(1)), ["_k"], k // 4)
    return sorted(r["feature"] for r in ranked.select("feature").collect())


def matrix(t):
    features = pool_features(t).persist()
    names = top_names(t, features)
    return K.feature_matrix(features, labels(t), names), names


@query("k04_forest_rank_scores")
def k04(t):
    rows, names = matrix(t)
    return K.model_rank_scores(rows, names, MAX, kinds=("forest",))


def sparse_scores(t, features, pool):
    return K.sparse_rank_scores(features, labels(t), pool, MAX, POOL)


@query("k05_sparse_logit_rank_scores")
def k05(t):
    """Every entity on its own candidate pool."""
    features = pool_features(t)
    return sparse_scores(t, features, durable(entity_pool(t, features)))


def psi_sql(recent: int, reference: int, smooth: str) -> str:
    share = (f"list_transform({{c}}, lambda x: (x + {smooth}) / (list_sum({{c}}) + {smooth} * len({{c}})))" if float(smooth) else
             "list_transform({c}, lambda x: GREATEST(x / GREATEST(list_sum({c}), 1.0), 1e-6))")
    hist = """list_transform(range(1, GREATEST(len(e), 2)), lambda i: CAST(len(list_filter({v}, lambda x: x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x = e[i + 1])))) AS DOUBLE))"""
    value = "CASE WHEN len(e) < 3 THEN 0.0 ELSE list_sum(list_transform(range(1, len(a) + 1), lambda i: (q[i] - p[i]) * LN(q[i] / p[i]))) END"
    if float(smooth):
        value = f"GREATEST(0.0, {value})"
    return f"""SELECT entity_id, feature, {value} AS psi FROM (SELECT *, {share.format(c='a')} AS p, {share.format(c='b')} AS q FROM (
 SELECT *, {hist.format(v='ref')} AS a, {hist.format(v='rec')} AS b FROM (
 SELECT entity_id, feature, list_sort(list_distinct(list_transform(QUANTILE_CONT(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (r > {recent}), lambda x: ROUND(x, 9)))) AS e,
 LIST(ROUND(value, 9)) FILTER (r > {recent}) AS ref, LIST(ROUND(value, 9)) FILTER (r <= {recent}) AS rec FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, feature ORDER BY period_end DESC) AS r, COUNT(*) OVER (PARTITION BY entity_id, feature) AS n FROM pool)
 WHERE r <= {recent + reference} AND n >= {recent + reference} AND value IS NOT NULL GROUP BY 1, 2) WHERE len(ref) >= 10 AND len(rec) >= 5))"""


B.add("psi_selector", psi_sql(12, 36, "0"))
B.add("psi_monitor", psi_sql(12, 24, "1e-4"))


@query("k06_psi_selector", sql="SELECT entity_id, feature, ROUND(psi, 6) AS psi FROM psi_selector")
def k06(t):
    return K.psi(pool_features(t), ["entity_id"], **K.PSI_SELECTOR).withColumn("psi", F.round("psi", 6))


@query("k07_psi_monitor", sql="SELECT entity_id, feature, ROUND(psi, 6) AS psi, psi > 0.20 AS drifted FROM psi_monitor")
def k07(t):
    df = K.psi(pool_features(t), ["entity_id"], **K.PSI_MONITOR)
    return df.select(*EF, F.round("psi", 6).alias("psi"), (F.col("psi") > 0.2).alias("drifted"))


def penalised(t):
    features = pool_features(t)
    drift = K.psi(features, ["entity_id"], **K.PSI_SELECTOR)
    return K.drift_penalty(entity_pool(t, features), drift, ["entity_id"], strength=0.05, severe=12.0)


@query("k08_drift_penalty", sql="""SELECT entity_id, feature, ROUND(score - 0.05 * LN(1 + GREATEST(0, COALESCE(psi, 0) - 0.2)), 6) AS score, COALESCE(psi >= 12.0, FALSE) AS severe,
 COALESCE(psi >= 9.0, FALSE) AS prunable FROM entity_pool LEFT JOIN psi_selector USING (entity_id, feature)""")
def k08(t):
    return penalised(t).select(*EF, F.round("score", 6).alias("score"), "severe", "prunable")


B.add("pool_carried", """SELECT p.entity_id, p.feature, period_end, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY p.entity_id, p.feature ORDER BY period_end) AS value
 FROM pool p JOIN entity_pool e ON p.entity_id = e.entity_id AND p.feature = e.feature""")


@query("k09_candidate_correlation", sql="""SELECT a.entity_id, a.feature, b.feature AS other, COUNT(*) AS n,
 ROUND(CASE WHEN STDDEV_POP(a.value) > 1e-9 AND STDDEV_POP(b.value) > 1e-9 THEN ABS(CORR(a.value, b.value)) END, 6) AS abs_corr
 FROM pool_carried a JOIN pool_carried b ON a.entity_id = b.entity_id AND a.period_end = b.period_end AND a.feature < b.feature
 WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3""")
def k09(t):
    features = pool_features(t)
    return K.pool_correlation(features, entity_pool(t, features)).withColumn("abs_corr", F.round("abs_corr", 6))


def assembled(t, features):
    """Correlation rank scores, the sparse fits' rank scores, and the penalty for drift."""
    pool = durable(entity_pool(t, features))
    fitted = sparse_scores(t, features, pool).groupBy(*EF).agg(F.sum("score").alias("_s"))
    ranked = pool.join(fitted, EF, "left").withColumn("score", F.col("score") + F.coalesce("_s", F.lit(0.0))).drop("_s")
    return K.drift_penalty(ranked, K.psi(features, ["entity_id"], **K.PSI_SELECTOR), ["entity_id"], strength=0.05, severe=12.0)


@query("k10_greedy_pruning")
def k10(t):
    features = pool_features(t)
    return K.select_features(assembled(t, features), features, MAX)


@query("k11_must_include")
def k11(t):
    features = pool_features(t)
    return K.select_features(assembled(t, features), features, MAX, list(catalog.MUST_INCLUDE))


@query("k12_binned_information", sql="""WITH c AS (SELECT entity_id, feature, bin, y, CAST(COUNT(*) AS DOUBLE) AS c FROM (
 SELECT *, NTILE(10) OVER (PARTITION BY entity_id, feature ORDER BY ROUND(value, 9), period_end) AS bin FROM pool_y) GROUP BY 1, 2, 3, 4)
SELECT entity_id, feature, ROUND(SUM(c / n * LN(c * n / (nb * ny))), 6) AS information FROM (SELECT *, SUM(c) OVER (PARTITION BY entity_id, feature) AS n,
 SUM(c) OVER (PARTITION BY entity_id, feature, bin) AS nb, SUM(c) OVER (PARTITION BY entity_id, feature, y) AS ny FROM c) GROUP BY 1, 2""")
def k12(t):
    return K.binned_information(pool_features(t), labels(t), ["entity_id"]).select(*EF, F.round("information", 6).alias("information"))


@query("k13_at_risk_share", sql=f"SELECT entity_id, ROUND(AVG(CASE WHEN {LAYER} = 'at_risk' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS at_risk_share FROM entity_pool WHERE rank <= 20 GROUP BY 1")
def k13(t):
    share = F.avg(F.when(X.layer() == "at_risk", 1.0).otherwise(0.0))
    return entity_pool(t).where("rank <= 20").groupBy("entity_id").agg(F.round(share, 6).alias("at_risk_share"))


@query("k14_ablation_candidates", sql=f"SELECT entity_id, feature, {BLOCK} AS block FROM entity_pool WHERE {BLOCK} IS NOT NULL")
def k14(t):
    return entity_pool(t).withColumn("block", X.block()).where("block is not null").select(*EF, "block")


# ---- monitoring -------------------------------------------------------------------

EM = ["entity_id", "model"]
B.add("stability", f"""SELECT entity_id, model, arg_max_null(v, period_end) AS current_vol, AVG(v) AS mean_vol, MAX(v) AS max_vol, arg_max_null(d, period_end) AS last_change FROM (
 SELECT *, {B.guarded('STDDEV_SAMP(prob)', 'prob', B.trail(6, 'entity_id, model'), 6)} AS v, ABS(prob - LAG(prob) OVER {B.over('', 'entity_id, model')}) AS d FROM score_panel) GROUP BY 1, 2""")


def stability(t):
    return M.stability(t.score_panel, EM)


@query("o01_stability", sql="""SELECT entity_id, model, ROUND(current_vol, 4) AS current_vol, ROUND(mean_vol, 4) AS mean_vol, ROUND(max_vol, 4) AS max_vol, ROUND(last_change, 4) AS last_change,
 current_vol > 0.15 AS volatile, last_change > 0.10 AS jumped FROM stability""")
def o01(t):
    df = stability(t)
    return df.select(*EM, *[F.round(c, 4).alias(c) for c in ("current_vol", "mean_vol", "max_vol", "last_change")],
                     (F.col("current_vol") > 0.15).alias("volatile"), (F.col("last_change") > 0.10).alias("jumped"))


B.add("disagreement", """SELECT entity_id, arg_max(spread, period_end) AS current_spread, arg_max(std, period_end) AS current_std, AVG(spread) AS mean_spread, QUANTILE_CONT(spread, 0.95) AS p95_spread FROM (
 SELECT entity_id, period_end, MAX(prob) - MIN(prob) AS spread, STDDEV_SAMP(prob) AS std FROM score_panel WHERE model <> 'ensemble' GROUP BY 1, 2) GROUP BY 1""")


def disagreement(t):
    return M.disagreement(t.score_panel.where("model <> 'ensemble'"), ["entity_id"])


@query("o02_disagreement", sql="""SELECT entity_id, ROUND(current_spread, 6) AS current_spread, ROUND(current_std, 6) AS current_std, ROUND(mean_spread, 6) AS mean_spread, ROUND(p95_spread, 6) AS p95_spread, current_spread > 0.3 AS alert FROM disagreement""")
def o02(t):
    df = disagreement(t)
    return df.select("entity_id", *r6(df, "current_spread", "current_std", "mean_spread", "p95_spread"), (F.col("current_spread") > 0.3).alias("alert"))


B.add("drift_summary", """SELECT entity_id, COUNT(*) AS checked, COUNT(*) FILTER (psi > 0.2) AS drifted, ROUND(AVG(psi), 4) AS mean_psi, MAX(psi) AS max_psi,
 COALESCE(string_agg(feature, ',' ORDER BY r) FILTER (psi > 0.2 AND r <= 5), '') AS top_drifted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY psi DESC, feature) AS r FROM (
 SELECT entity_id, feature, ROUND(psi, 4) AS psi FROM psi_monitor)) GROUP BY 1""")


def drift(t):
    return M.drift_summary(K.psi(pool_features(t), ["entity_id"], **K.PSI_MONITOR), ["entity_id"])


@query("o03_drift_summary", sql="SELECT entity_id, checked, drifted, mean_psi, max_psi, top_drifted FROM drift_summary")
def o03(t):
    return drift(t)


B.add("ensemble_rows", "SELECT entity_id, period_end, y, prob FROM score_panel WHERE model = 'ensemble'")
B.add("gap", """SELECT entity_id, COUNT(*) AS months, AVG(prob) AS mean_predicted, AVG(y) AS observed_rate, COUNT(y) AS observed_months, ABS(AVG(prob) - AVG(y)) AS gap FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS r FROM ensemble_rows) WHERE r <= 24 GROUP BY 1 HAVING COUNT(*) >= 24""")


def ensemble_rows(t):
    return t.score_panel.where("model = 'ensemble'").select("entity_id", "period_end", "y", "prob")


@query("o04_calibration_gap", sql="SELECT entity_id, ROUND(mean_predicted, 6) AS mean_predicted, ROUND(observed_rate, 6) AS observed_rate, observed_months, ROUND(gap, 6) AS gap, gap > 0.15 AS alert FROM gap")
def o04(t):
    df = M.calibration_gap(ensemble_rows(t), ["entity_id"])
    return df.select("entity_id", *r6(df, "mean_predicted", "observed_rate"), "observed_months", F.round("gap", 6).alias("gap"), (F.col("gap") > 0.15).alias("alert"))


B.add("recent60", """SELECT entity_id, period_end, y, prob FROM (SELECT *, COUNT(*) OVER (PARTITION BY entity_id) AS n, MIN(y) OVER (PARTITION BY entity_id) AS lo, MAX(y) OVER (PARTITION BY entity_id) AS hi FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS r FROM ensemble_rows WHERE y IS NOT NULL) WHERE r <= 60) WHERE n >= 12 AND lo < hi""")
B.add("recent60_bins", reliability_sql("recent60", "entity_id"))
QSLOPE = newton_sql("newton60", "recent60", "entity_id")
B.add("quality", f"""SELECT entity_id, n_samples AS months, ece, a AS slope, b AS intercept, reliability, resolution, uncertainty, brier_total FROM ({ece_sql('recent60', 'entity_id')})
 JOIN {QSLOPE} USING (entity_id) JOIN ({brier_sql('recent60_bins', 'entity_id')}) USING (entity_id)""")


def quality(t):
    return M.calibration_quality(ensemble_rows(t), ["entity_id"])


@query("o05_calibration_quality", sql="""SELECT entity_id, months, ROUND(ece, 4) AS ece, ROUND(slope, 4) AS slope, ROUND(intercept, 4) AS intercept, ROUND(reliability, 5) AS reliability, ROUND(resolution, 5) AS resolution,
 ROUND(uncertainty, 5) AS uncertainty, ROUND(brier_total, 5) AS brier_total FROM quality""")
def o05(t):
    df = quality(t)
    four = [F.round(c, 4).alias(c) for c in ("ece", "slope", "intercept")]
    return df.select("entity_id", "months", *four, *[F.round(c, 5).alias(c) for c in ("reliability", "resolution", "uncertainty", "brier_total")])


AS_OF = "2001-09-20"
B.add("fresh", f"SELECT entity_id, MAX(period_end) AS latest, date_diff('day', MAX(period_end), DATE '{AS_OF}') AS days_old FROM score_panel GROUP BY 1")


@query("o06_freshness", sql="SELECT entity_id, latest, days_old, days_old > 45 AS stale FROM fresh")
def o06(t):
    df = M.freshness(t.score_panel, ["entity_id"], AS_OF)
    return df.select("entity_id", "latest", F.col("days_old").cast("bigint").alias("days_old"), (F.col("days_old") > 45).alias("stale"))


@query("o07_report", sql="""WITH a AS (SELECT entity_id FROM stability WHERE model = 'ensemble' AND current_vol > 0.15 UNION ALL SELECT entity_id FROM stability WHERE model = 'ensemble' AND last_change > 0.10
 UNION ALL SELECT entity_id FROM disagreement WHERE current_spread > 0.3 UNION ALL SELECT entity_id FROM drift_summary WHERE drifted > 0 UNION ALL SELECT entity_id FROM gap WHERE gap > 0.15
 UNION ALL SELECT entity_id FROM quality WHERE ece > 0.10 UNION ALL SELECT entity_id FROM quality WHERE slope < 0.5 OR slope > 1.5 UNION ALL SELECT entity_id FROM fresh WHERE days_old > 45)
SELECT e.entity_id, COUNT(a.entity_id) AS n_alerts, CASE WHEN COUNT(a.entity_id) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT DISTINCT entity_id FROM score_panel) e LEFT JOIN a ON a.entity_id = e.entity_id GROUP BY 1""")
def o07(t):
    keys = ["entity_id"]
    checks = {
        "stability": stability(t).where("model = 'ensemble'"), "disagreement": disagreement(t), "drift": drift(t),
        "gap": M.calibration_gap(ensemble_rows(t), keys), "quality": quality(t), "freshness": M.freshness(t.score_panel, keys, AS_OF)}
    return M.report(M.alerts(checks, keys), t.score_panel.select("entity_id").distinct(), keys)
