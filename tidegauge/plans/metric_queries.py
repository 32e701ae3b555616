"""Evaluation metrics (V01-V11), thresholds, weights and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import ensemble as E
from tidegauge.operators import labels as L
from tidegauge.operators import metrics as V
from tidegauge.plans import oracle_base as B
from tidegauge.plans.composite_queries import labelled
from tidegauge.plans.registry import query

RM = ["run_id", "model"]


def r6(df, *names):
    return [F.round(n, 6).alias(n) for n in names]


RATES = """COALESCE(n_tp / NULLIF(n_tp + n_fp, 0), 0) AS precision, COALESCE(n_tp / NULLIF(n_tp + n_fn, 0), 0) AS recall,
 COALESCE(n_tn / NULLIF(n_tn + n_fp, 0), 0) AS specificity, (n_tp + n_tn) / (n_tp + n_fp + n_fn + n_tn) AS accuracy"""


def metrics_sql(source: str, keys: str, cut: str = "0.5", eps: str = "1e-7", extra: str = "") -> str:
    """Grouped metrics over a relation with columns keys, prob, y."""
    q = f"GREATEST({eps}, LEAST(1 - {eps}, prob))"
    return f"""SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1, recall + specificity - 1 AS youdens_j FROM (
 SELECT *, {RATES} FROM (SELECT {keys}, SUM(fp * (ctp - tp / 2)) / NULLIF(SUM(tp) * SUM(fp), 0) AS auc, SUM(tp * ctp / (ctp + cfp)) / NULLIF(SUM(tp), 0) AS pr_auc,
 SUM(tp * (1 - prob) * (1 - prob) + fp * prob * prob) / SUM(tp + fp) AS brier, SUM(-(tp * LN({q}) + fp * LN(1 - {q}))) / SUM(tp + fp) AS log_loss,
 CAST(SUM(CASE WHEN prob >= {cut} THEN tp ELSE 0 END) AS BIGINT) AS n_tp, CAST(SUM(CASE WHEN prob >= {cut} THEN fp ELSE 0 END) AS BIGINT) AS n_fp,
 CAST(SUM(CASE WHEN prob >= {cut} THEN 0 ELSE tp END) AS BIGINT) AS n_fn, CAST(SUM(CASE WHEN prob >= {cut} THEN 0 ELSE fp END) AS BIGINT) AS n_tn{extra}
 FROM (SELECT *, SUM(tp) OVER (PARTITION BY {keys} ORDER BY prob DESC) AS ctp, SUM(fp) OVER (PARTITION BY {keys} ORDER BY prob DESC) AS cfp FROM (
 SELECT {keys}, prob, CAST(SUM(y) AS DOUBLE) AS tp, CAST(SUM(1 - y) AS DOUBLE) AS fp FROM {source} WHERE prob IS NOT NULL AND y IS NOT NULL GROUP BY {keys}, prob)) GROUP BY {keys}))"""


B.add("score_metrics", metrics_sql("scores", "run_id, model"))
B.add("panel_metrics", metrics_sql("score_panel", "entity_id, model", "0.45"))


def table(t):
    return V.metrics_table(t.scores, RM, 0.5)


@query("v01_auc", sql="SELECT run_id, model, ROUND(auc, 6) AS auc FROM score_metrics")
def v01(t):
    return table(t).select(*RM, F.round("auc", 6).alias("auc"))


@query("v02_average_precision", sql="SELECT run_id, model, ROUND(pr_auc, 6) AS pr_auc FROM score_metrics")
def v02(t):
    return table(t).select(*RM, F.round("pr_auc", 6).alias("pr_auc"))


@query("v03_brier", sql="SELECT run_id, model, ROUND(AVG((prob - y) * (prob - y)), 6) AS brier FROM scores GROUP BY 1, 2")
def v03(t):
    return t.scores.groupBy(*RM).agg(F.round(F.avg(F.pow(F.col("prob") - F.col("y"), 2)), 6).alias("brier"))


@query("v04_log_loss", sql="""SELECT run_id, model, ROUND(AVG(-(y * LN(q) + (1 - y) * LN(1 - q))), 6) AS log_loss FROM (
 SELECT *, GREATEST(1e-6, LEAST(1 - 1e-6, prob)) AS q FROM scores) GROUP BY 1, 2""")
def v04(t):
    return V.metrics_table(t.scores, RM, 0.5, eps=1e-6).select(*RM, F.round("log_loss", 6).alias("log_loss"))


@query("v05_confusion", sql="""SELECT run_id, model, n_tp, n_fp, n_fn, n_tn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
 ROUND(accuracy, 6) AS accuracy, ROUND(specificity, 6) AS specificity, ROUND(youdens_j, 6) AS youdens_j FROM score_metrics""")
def v05(t):
    df = table(t)
    return df.select(*RM, "n_tp", "n_fp", "n_fn", "n_tn", *r6(df, "precision", "recall", "f1", "accuracy", "specificity", "youdens_j"))


HIGH = ["auc", "pr_auc", "precision", "recall", "f1", "accuracy", "specificity", "youdens_j"]
LOW = ["brier", "log_loss"]


@query("v06_metrics_table", sql=f"""SELECT run_id, model, {', '.join(f'ROUND({c}, 6) AS {c}' for c in HIGH + LOW)} FROM score_metrics""")
def v06(t):
    df = table(t)
    return df.select(*RM, *r6(df, *HIGH, *LOW))


@query("v06_best_per_metric", sql=f"""WITH l AS (SELECT run_id, model, metric, ROUND(v, 9) AS v FROM score_metrics UNPIVOT (v FOR metric IN ({', '.join(HIGH + LOW)})))
SELECT run_id, metric, model AS best_model, ROUND(v, 6) AS best_value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, metric
 ORDER BY CASE WHEN metric IN ('brier', 'log_loss') THEN -v ELSE v END DESC, model) AS r FROM l) WHERE r = 1""")
def v06_best(t):
    return V.best_per_metric(table(t), ["run_id"]).withColumn("best_value", F.round("best_value", 6))


ROLL = metrics_sql("expanded", "entity_id, model, e", "0.45")


@query("v07_rolling_metrics", sql=f"""WITH numbered AS (SELECT entity_id, model, period_end, y, GREATEST(1e-7, LEAST(1 - 1e-7, prob)) AS prob,
 ROW_NUMBER() OVER (PARTITION BY entity_id, model ORDER BY period_end) AS r FROM score_panel WHERE y IS NOT NULL),
expanded AS (SELECT a.entity_id, a.model, b.r AS e, a.period_end, a.y, a.prob FROM numbered a JOIN numbered b ON a.entity_id = b.entity_id AND a.model = b.model
 AND a.r BETWEEN b.r - 35 AND b.r AND b.r >= 36),
spans AS (SELECT entity_id, model, e, MIN(period_end) AS window_start, MAX(period_end) AS window_end, COUNT(*) AS months, CAST(SUM(y) AS BIGINT) AS positives FROM expanded GROUP BY 1, 2, 3),
m AS ({ROLL})
SELECT entity_id, model, window_start, window_end, months, positives, ROUND(auc, 6) AS auc, ROUND(pr_auc, 6) AS pr_auc, ROUND(brier, 6) AS brier,
 ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, ROUND(specificity, 6) AS specificity, ROUND(youdens_j, 6) AS youdens_j, n_tp, n_fp, n_fn, n_tn
FROM m JOIN spans USING (entity_id, model, e)""")
def v07(t):
    df = V.rolling_metrics(t.score_panel, ["entity_id", "model"], 36, 0.45)
    return df.select("entity_id", "model", "window_start", "window_end", "months", "positives",
                     *r6(df, "auc", "pr_auc", "brier", "precision", "recall", "f1", "specificity", "youdens_j"), "n_tp", "n_fp", "n_fn", "n_tn")


@query("v10_best_of_members", sql="""SELECT run_id, ROUND(MAX(auc), 6) AS best_auc, ROUND(MAX(pr_auc), 6) AS best_pr_auc, ROUND(MIN(brier), 6) AS best_brier FROM score_metrics GROUP BY 1""")
def v10(t):
    return table(t).groupBy("run_id").agg(F.round(F.max("auc"), 6).alias("best_auc"), F.round(F.max("pr_auc"), 6).alias("best_pr_auc"),
                                          F.round(F.min("brier"), 6).alias("best_brier"))


@query("v11_metric_deltas", sql="""WITH l AS (SELECT run_id, model, metric, v FROM score_metrics UNPIVOT (v FOR metric IN (auc, brier, pr_auc)))
SELECT c.run_id, c.metric, ROUND(c.v, 6) AS challenger, ROUND(b.v, 6) AS baseline, ROUND(c.v - b.v, 6) AS delta, ROUND(100 * (c.v - b.v) / NULLIF(ABS(b.v), 0), 6) AS delta_pct
FROM l c JOIN l b ON c.run_id = b.run_id AND c.metric = b.metric AND c.model = 'm3' AND b.model = 'm1'""")
def v11(t):
    df = V.deltas(table(t), ["run_id"], ["auc", "brier", "pr_auc"], "model", "m3", "m1")
    return df.select("run_id", "metric", *r6(df, "challenger", "baseline", "delta", "delta_pct"))


# ---- ensemble -------------------------------------------------------------------

B.add("members", """SELECT run_id, model, COALESCE(auc, 0.5) AS auc, COALESCE(pr_auc, 0.0) AS pr_auc, brier, 1 / (brier + 1e-6) AS inv_brier FROM score_metrics""")


def members(t):
    return E.member_scores(t.scores, ["run_id"])


@query("e01_member_scores", sql="SELECT run_id, model, ROUND(auc, 6) AS auc, ROUND(pr_auc, 6) AS pr_auc, ROUND(brier, 6) AS brier, ROUND(inv_brier, 6) AS inv_brier FROM members")
def e01(t):
    df = members(t)
    return df.select(*RM, *r6(df, "auc", "pr_auc", "brier", "inv_brier"))


@query("e02_static_weights", sql="SELECT run_id, model, ROUND(inv_brier / SUM(inv_brier) OVER (PARTITION BY run_id), 6) AS weight FROM members")
def e02(t):
    return E.static_weights(members(t), ["run_id"]).select(*RM, F.round("weight", 6).alias("weight"))


FOLDED = """SELECT fold, entity_id, period_end, model, prob, y FROM (SELECT *, n // 6 AS ts, UNNEST(range(5)) AS fold FROM labelled_n)
 UNPIVOT (prob FOR model IN (m1, m2, m3)) WHERE rn > n - ts * (5 - fold) AND rn <= n - ts * (5 - fold) + ts"""
B.add("folded", FOLDED)
B.add("fold_metrics", f"SELECT fold, model, COALESCE(auc, 0.5) AS auc, brier FROM ({metrics_sql('folded', 'fold, model')})")
B.add("decayed", """SELECT model, s / SUM(s) OVER () AS weight FROM (SELECT model, SUM(POW(0.99, 4 - fold) * auc / (brier + 0.01)) / SUM(POW(0.99, 4 - fold)) AS s FROM fold_metrics GROUP BY 1)""")


def folded(t):
    """Test rows of every fold with their member scores."""
    names = ["m1", "m2", "m3"]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in names])
    return L.time_folds(labelled(t)).where("role = 'test'").select("fold", "entity_id", "period_end", "y", F.inline(pairs))


def fold_metrics(t):
    table = V.metrics_table(folded(t), ["fold", "model"])
    return table.select(F.lit("cv").alias("run_id"), "fold", "model", F.coalesce("auc", F.lit(0.5)).alias("auc"), "brier")


@query("e03_decayed_weights", sql="SELECT model, ROUND(weight, 6) AS weight FROM decayed")
def e03(t):
    return E.decayed_weights(fold_metrics(t), ["run_id"], 5).select("model", F.round("weight", 6).alias("weight"))


def skewed_weights(t):
    """Run weights pushed apart so that the cap and the floor both bind."""
    base = t.scores.groupBy("run_id", "model").agg((F.avg("prob") + F.lit(0.0)).alias("w"))
    power = base.withColumn("w", F.pow("w", F.when(F.col("model") == "m4", 6.0).otherwise(2.0)))
    return power.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("run_id"))).drop("w")


_STEP = """SELECT run_id, list_transform(m, lambda x, j: {{'model': x.model, 'weight': CASE WHEN m[{i}].weight <= 0.4 THEN x.weight WHEN j = {i} THEN 0.4
 ELSE x.weight + (m[{i}].weight - 0.4) * x.weight / (list_sum(list_transform(m, lambda z: z.weight)) - m[{i}].weight) END}}) AS m FROM ({src})"""
_cap = """SELECT run_id, LIST({'model': model, 'weight': w / t} ORDER BY model) AS m FROM (SELECT *, SUM(w) OVER (PARTITION BY run_id) AS t FROM (
 SELECT run_id, model, POW(AVG(prob), CASE WHEN model = 'm4' THEN 6 ELSE 2 END) AS w FROM scores GROUP BY 1, 2)) GROUP BY 1"""
for _ in range(3):
    for _i in range(1, 5):
        _cap = _STEP.format(i=_i, src=_cap)


@query("e04_cap_and_floor", sql=f"""SELECT run_id, x.model AS model, ROUND(GREATEST(x.weight, 0.02) / list_sum(list_transform(m, lambda z: GREATEST(z.weight, 0.02))), 6) AS weight
FROM (SELECT run_id, m, UNNEST(m) AS x FROM ({_cap}))""")
def e04(t):
    return E.cap_and_floor(skewed_weights(t), ["run_id"]).select("run_id", "model", F.round("weight", 6).alias("weight"))


B.add("active", """SELECT *, CASE WHEN SUM(CAST(ok AS INT)) OVER (PARTITION BY run_id) >= 2 THEN ok ELSE rk <= 2 END AS active FROM (
 SELECT *, auc >= MAX(auc) OVER p - 0.10 AND pr_auc >= MAX(pr_auc) OVER p * 0.90 AND brier <= MIN(brier) OVER p * 2.0 AS ok,
 ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY auc DESC, brier, model) AS rk FROM members WINDOW p AS (PARTITION BY run_id))""")


@query("e05_active_gate", sql="SELECT run_id, model, active FROM active")
def e05(t):
    return E.active_members(members(t), ["run_id"]).select(*RM, "active")


B.add("blended_weights", """SELECT run_id, model, active, CASE WHEN active THEN 1.0 / SUM(CAST(active AS INT)) OVER p ELSE 0 END AS equal_weight,
 CASE WHEN active THEN inv_brier ELSE 0 END / SUM(CASE WHEN active THEN inv_brier ELSE 0 END) OVER p AS weight FROM active WINDOW p AS (PARTITION BY run_id)""")


def weighted(t):
    active = E.equal_active_weights(E.active_members(members(t), ["run_id"]), ["run_id"])
    return E.renormalise(active.withColumn("weight", F.col("inv_brier")), ["run_id"])


@query("e06_equal_and_renormalised", sql="SELECT run_id, model, ROUND(equal_weight, 6) AS equal_weight, ROUND(weight, 6) AS weight FROM blended_weights")
def e06(t):
    df = weighted(t)
    return df.select(*RM, *r6(df, "equal_weight", "weight"))


@query("e07_shrinkage", sql="SELECT run_id, model, ROUND(0.75 * weight + 0.25 * equal_weight, 6) AS quarter, ROUND(equal_weight, 6) AS full_shrink FROM blended_weights")
def e07(t):
    w = weighted(t)
    return E.shrink(w, 0.25).select(*RM, F.round("weight", 6).alias("quarter"), F.round("equal_weight", 6).alias("full_shrink"))


@query("e08_blend", sql="""SELECT run_id, row_id, ROUND(SUM(weight * prob), 6) AS prob FROM scores JOIN blended_weights USING (run_id, model) GROUP BY 1, 2""")
def e08(t):
    return E.blend(t.scores, weighted(t), ["run_id"], ["row_id"]).withColumn("prob", F.round("prob", 6))


B.add("sweep", """SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1,
 COALESCE(5 * precision * recall / NULLIF(4 * precision + recall, 0), 0) AS f2, recall + specificity - 1 AS youdens_j FROM (
 SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall, COALESCE(tn / NULLIF(tn + fp, 0), 0) AS specificity FROM (
 SELECT run_id, model, i / 100.0e0 AS threshold, COUNT(*) FILTER (prob >= i / 100.0e0 AND y = 1) AS tp, COUNT(*) FILTER (prob >= i / 100.0e0 AND y = 0) AS fp,
 COUNT(*) FILTER (prob < i / 100.0e0 AND y = 1) AS fn, COUNT(*) FILTER (prob < i / 100.0e0 AND y = 0) AS tn FROM scores, range(10, 61) AS g(i) GROUP BY 1, 2, 3))""")
SWEEP = ["precision", "recall", "specificity", "f1", "f2", "youdens_j"]


def sweep(t):
    return E.threshold_sweep(t.scores, RM)


@query("e09_threshold_sweep", sql=f"SELECT run_id, model, threshold, tp, fp, fn, tn, {', '.join(f'ROUND({c}, 6) AS {c}' for c in SWEEP)}, ROUND(f1, 6) AS score FROM sweep")
def e09(t):
    df = sweep(t)
    return df.select(*RM, "threshold", "tp", "fp", "fn", "tn", *r6(df, *SWEEP, "score"))


B.add("chosen", """SELECT run_id, model, CASE WHEN tp + fn = 0 OR fp + tn = 0 THEN 0.5 ELSE threshold END AS threshold, f1, precision, recall, specificity FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, model ORDER BY f1 DESC, precision DESC, recall DESC, specificity DESC, threshold) AS r FROM sweep) WHERE r = 1""")


@query("e10_choose_threshold", sql="SELECT run_id, model, threshold, ROUND(f1, 6) AS f1, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(specificity, 6) AS specificity FROM chosen")
def e10(t):
    df = E.choose_threshold(sweep(t), RM)
    return df.select(*RM, "threshold", *r6(df, "f1", "precision", "recall", "specificity"))


def _plateau(tol, flat):
    return f"""WITH w AS (SELECT run_id, model, threshold AS wt, f1 AS wf FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, model ORDER BY f1 DESC, precision DESC, recall DESC, specificity DESC, threshold) AS r FROM sweep) WHERE r = 1),
p AS (SELECT run_id, model, MAX(wt) AS winner_threshold, ROUND(MAX(wf), 6) AS winner_f1, COUNT(*) FILTER (f1 >= wf - 0.01) AS width_01, COUNT(*) FILTER (f1 >= wf - 0.005) AS width_005,
 MIN(threshold) FILTER (f1 >= wf - {tol}) AS plateau_min, MAX(threshold) FILTER (f1 >= wf - {tol}) AS plateau_max FROM sweep JOIN w USING (run_id, model) GROUP BY 1, 2)
SELECT *, ROUND(plateau_max - plateau_min, 4) AS span, {flat} AS is_flat FROM p"""


@query("e11_plateau", sql=_plateau("0.01", "width_005 >= 5"))
def e11(t):
    return E.plateau(sweep(t), RM)


@query("e12_plateau_audit", sql=_plateau("0.005", "width_005 >= 5 OR ROUND(plateau_max - plateau_min, 4) >= 0.10"))
def e12(t):
    return E.plateau(sweep(t), RM, audit=True)


@query("e13_manual_threshold", sql="SELECT run_id, model, COALESCE(CASE WHEN model = 'm2' THEN 0.35 END, threshold) AS threshold FROM chosen")
def e13(t):
    chosen = E.choose_threshold(sweep(t), RM).withColumn("manual", F.when(F.col("model") == "m2", 0.35))
    return E.override_threshold(chosen).select(*RM, "threshold")


B.add("gate_pairs", """SELECT c.run_id, c.auc AS ca, i.auc AS ia, c.pr_auc AS cp, i.pr_auc AS ip, c.brier AS cb, i.brier AS ib, c.log_loss AS cl, i.log_loss AS il
 FROM score_metrics c JOIN score_metrics i ON c.run_id = i.run_id AND c.model = 'm3' AND i.model = 'm2'""")


@query("e14_promotion_gate", sql="""SELECT run_id, len(b) = 0 AS passed, CASE WHEN len(b) = 0 AND better THEN 'matched or improved all guardrails' WHEN len(b) = 0 THEN 'matched incumbent on all guardrails'
 ELSE concat('underperformed incumbent on ', array_to_string(b, ', ')) END AS reason FROM (SELECT run_id, list_filter([CASE WHEN NOT COALESCE(ca >= ia - 1e-9, FALSE) THEN 'auc' END,
 CASE WHEN NOT COALESCE(cp >= ip - 1e-9, FALSE) THEN 'pr_auc' END, CASE WHEN NOT COALESCE(cb <= ib + 1e-9, FALSE) THEN 'brier' END,
 CASE WHEN NOT COALESCE(cl <= il + 1e-9, FALSE) THEN 'log_loss' END], lambda x: x IS NOT NULL) AS b,
 ca > ia + 1e-6 OR cp > ip + 1e-6 OR cb < ib - 1e-6 OR cl < il - 1e-6 AS better FROM gate_pairs)""")
def e14(t):
    at = lambda model, m: F.max(F.when(F.col("model") == model, F.col(m)))
    pairs = table(t).groupBy("run_id").agg(
        *[at("m3", m).alias(f"candidate_{m}") for m in E.GATE], *[at("m2", m).alias(f"incumbent_{m}") for m in E.GATE])
    return E.promotion_gate(pairs, ["run_id"])


@query("e15_config_identity", sql="""WITH c AS (SELECT o_custkey, MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT o_custkey, a = b AS same FROM c""")
def e15(t):
    per = t.read("orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b"), F.min("o_orderstatus").alias("s"))
    left = F.create_map(F.lit("priority"), "a", F.lit("status"), "s")
    right = F.create_map(F.lit("status"), F.col("s"), F.lit("priority"), F.col("b"))
    return per.withColumns({"x": left, "y": right}).select("o_custkey", E.same_config("x", "y").alias("same"))


B.add("loo_rows", """SELECT run_id, row_id, y, model, ROUND(CASE WHEN model = 'all' THEN (m1 + m2 + m3 + m4) / 4 ELSE p END, 12) AS prob FROM (
 SELECT run_id, row_id, y, m1, m2, m3, m4, UNNEST(['all', 'm1', 'm2', 'm3', 'm4']) AS model,
 UNNEST([0, (m2 + m3 + m4) / 3, (m1 + m3 + m4) / 3, (m1 + m2 + m4) / 3, (m1 + m2 + m3) / 3]) AS p FROM score_rows)""")
B.add("loo_metrics", metrics_sql("loo_rows", "run_id, model"))


@query("e16_leave_one_out", sql="""SELECT l.run_id, l.model, ROUND(l.brier, 6) AS brier_without, ROUND(l.brier - a.brier, 6) AS brier_delta, ROUND(l.auc, 6) AS auc_without,
 ROUND(a.brier, 6) AS reference_brier, ROUND(a.auc, 6) AS reference_auc FROM loo_metrics l JOIN loo_metrics a ON l.run_id = a.run_id AND a.model = 'all' AND l.model <> 'all'""")
def e16(t):
    df = E.leave_one_out(t.score_rows, ["run_id"], ["row_id"], ["m1", "m2", "m3", "m4"])
    return df.select(*RM, *r6(df, "brier_without", "brier_delta", "auc_without", "reference_brier", "reference_auc"))
