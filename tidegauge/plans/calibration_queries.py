"""Calibration (C01-C13), uncertainty (U01-U08) and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import calibration as C
from tidegauge.operators import uncertainty as U
from tidegauge.plans import oracle_base as B
from tidegauge.plans.composite_queries import labelled
from tidegauge.plans.metric_queries import r6
from tidegauge.plans.registry import query

RM = ["run_id", "model"]


def reliability_sql(source: str, keys: str, strategy: str = "quantile") -> str:
    """Bins of a relation with keys, prob, y."""
    if strategy == "quantile":
        edges = f"""SELECT {keys}, list_sort(list_distinct(list_transform(QUANTILE_CONT(prob, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda e: ROUND(e, 9)))) AS e
 FROM {source} WHERE y IS NOT NULL GROUP BY {keys}"""
    else:
        edges = f"SELECT DISTINCT {keys}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0] AS e FROM {source}"
    return f"""SELECT {keys}, bin, MAX((e[bin + 1] + e[LEAST(bin + 2, len(e))]) / 2) AS centre, AVG(y) AS observed, AVG(prob) AS predicted, COUNT(*) AS n FROM (
 SELECT s.*, e, len(list_filter(e[2:len(e) - 1], lambda x: x <= ROUND(prob, 9))) AS bin FROM {source} s JOIN ({edges}) USING ({keys}) WHERE y IS NOT NULL) GROUP BY {keys}, bin"""


def ece_sql(source: str, keys: str) -> str:
    inner = " + ".join(f"CASE WHEN prob >= {i * 0.1!r}e0 THEN 1 ELSE 0 END" for i in range(1, 10))
    return f"""SELECT {keys}, SUM(n * ABS(o - p)) / SUM(n) AS ece, CAST(SUM(n) AS BIGINT) AS n_samples FROM (SELECT {keys}, {inner} AS bin, COUNT(*) AS n, AVG(y) AS o, AVG(prob) AS p
 FROM {source} WHERE y IS NOT NULL AND prob IS NOT NULL GROUP BY {keys}, bin) GROUP BY {keys}"""


def brier_sql(bins: str, keys: str) -> str:
    return f"""SELECT {keys}, reliability, resolution, b * (1 - b) AS uncertainty, reliability - resolution + b * (1 - b) AS brier_total FROM (
 SELECT {keys}, SUM(n * observed) / SUM(n) AS b, SUM(n * (predicted - observed) * (predicted - observed)) / SUM(n) AS reliability,
 SUM(n * observed * observed) / SUM(n) - POW(SUM(n * observed) / SUM(n), 2) AS resolution FROM {bins} GROUP BY {keys})"""


def newton_sql(prefix: str, source: str, keys: str, steps: int = 10) -> str:
    """Shared expressions for the unrolled logistic fit; returns the name of the last one."""
    on = " AND ".join(f"d.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    d_keys = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    B.add(f"{prefix}_data", f"""SELECT {keys}, LN(q / (1 - q)) AS x, n, t FROM (SELECT {keys}, GREATEST(1e-6, LEAST(1 - 1e-6, prob)) AS q, CAST(COUNT(*) AS DOUBLE) AS n, SUM(y) AS t
 FROM {source} WHERE y IS NOT NULL AND prob IS NOT NULL GROUP BY {keys}, q)""")
    B.add(f"{prefix}_0", f"SELECT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {prefix}_data GROUP BY {keys} HAVING SUM(t) > 0 AND SUM(t) < SUM(n)")
    for i in range(steps):
        B.add(f"{prefix}_{i + 1}", f"""SELECT {keys}, a + COALESCE((h22 * ga - h12 * gb) / NULLIF(h11 * h22 - h12 * h12, 0), 0) AS a, b + COALESCE((h11 * gb - h12 * ga) / NULLIF(h11 * h22 - h12 * h12, 0), 0) AS b FROM (
 SELECT {keys}, a, b, SUM((t - n * mu) * x) AS ga, SUM(t - n * mu) AS gb, SUM(n * mu * (1 - mu) * x * x) AS h11, SUM(n * mu * (1 - mu) * x) AS h12, SUM(n * mu * (1 - mu)) AS h22 FROM (
 SELECT {d_keys}, c.a, c.b, d.x, d.n, d.t, 1 / (1 + EXP(-(c.a * d.x + c.b))) AS mu FROM {prefix}_data d JOIN {prefix}_{i} c ON {on}) GROUP BY {keys}, a, b)""")
    return f"{prefix}_{steps}"


B.add("score_bins", reliability_sql("scores", "run_id, model"))
SLOPE = newton_sql("newton", "scores", "run_id, model")
B.add("score_ece", ece_sql("scores", "run_id, model"))
B.add("score_brier", brier_sql("score_bins", "run_id, model"))


@query("c01_reliability", longs=("bin",), sql="""SELECT run_id, model, bin, ROUND(centre, 6) AS centre, ROUND(observed, 6) AS observed, ROUND(predicted, 6) AS predicted, n FROM score_bins""")
def c01(t):
    df = C.reliability(t.scores, RM)
    return df.select(*RM, "bin", *r6(df, "centre", "observed", "predicted"), "n")


@query("c01_reliability_uniform", longs=("bin",), sql=f"""SELECT entity_id, model, bin, ROUND(centre, 6) AS centre, ROUND(observed, 6) AS observed, ROUND(predicted, 6) AS predicted, n FROM ({reliability_sql('score_panel', 'entity_id, model', 'uniform')})""")
def c01_uniform(t):
    df = C.reliability(t.score_panel, ["entity_id", "model"], strategy="uniform")
    return df.select("entity_id", "model", "bin", *r6(df, "centre", "observed", "predicted"), "n")


@query("c02_ece", sql="SELECT run_id, model, ROUND(ece, 6) AS ece, n_samples FROM score_ece")
def c02(t):
    return C.calibration_error(t.scores, RM).withColumn("ece", F.round("ece", 6))


@query("c03_slope_intercept", sql=f"SELECT run_id, model, ROUND(a, 5) AS slope, ROUND(b, 5) AS intercept FROM {SLOPE}")
def c03(t):
    return C.slope_intercept(t.scores, RM).select(*RM, F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("c04_brier_parts", sql="""SELECT run_id, model, ROUND(reliability, 6) AS reliability, ROUND(resolution, 6) AS resolution, ROUND(uncertainty, 6) AS uncertainty, ROUND(brier_total, 6) AS brier_total FROM score_brier""")
def c04(t):
    df = C.brier_parts(t.scores, RM)
    return df.select(*RM, *r6(df, "reliability", "resolution", "uncertainty", "brier_total"))


@query("c05_sigmoid_calibration", sql=f"""SELECT run_id, model, row_id, ROUND(COALESCE(1 / (1 + EXP(-(a * LN(q / (1 - q)) + b))), GREATEST(0.01, LEAST(0.99, prob))), 5) AS calibrated
FROM (SELECT *, GREATEST(1e-6, LEAST(1 - 1e-6, prob)) AS q FROM scores) LEFT JOIN {SLOPE} USING (run_id, model)""")
def c05(t):
    fit = C.slope_intercept(t.scores, RM)
    return C.apply_sigmoid(t.scores, fit, RM).select(*RM, "row_id", F.round("calibrated", 5).alias("calibrated"))


def pooled(t):
    """Out-of-fold style pool: labelled ensemble months in time order, numbered over (entity, month)."""
    return labelled(t).select("entity_id", "period_end", F.col("ensemble").alias("prob"), "y")


# Monotone maps by the min-max formula over distinct scores: the largest, over beginnings up to a score, of the least mean of the
# stretches that reach it.
B.add("iso_cells", """SELECT *, SUM(n) OVER w AS cn, SUM(t) OVER w AS ct FROM (SELECT run_id, model, prob, CAST(COUNT(*) AS DOUBLE) AS n, SUM(y) AS t FROM scores GROUP BY 1, 2, 3)
 WINDOW w AS (PARTITION BY run_id, model ORDER BY prob)""")
B.add("iso", """SELECT run_id, model, prob, GREATEST(0.01, LEAST(0.99, MAX(least_mean))) AS calibrated FROM (
 SELECT a.run_id, a.model, b.prob, MIN((b.ct - a.ct + a.t) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.run_id, a.model, a.prob ORDER BY b.prob DESC) AS least_mean
 FROM iso_cells a JOIN iso_cells b ON a.run_id = b.run_id AND a.model = b.model AND b.prob >= a.prob) GROUP BY 1, 2, 3""")


@query("c06_isotonic_calibration", sql="SELECT run_id, model, prob, CAST(n AS BIGINT) AS n, ROUND(calibrated, 6) AS calibrated FROM iso JOIN iso_cells USING (run_id, model, prob)")
def c06(t):
    cells = t.scores.groupBy(*RM, "prob").agg(F.count(F.lit(1)).alias("n"))
    return C.isotonic(t.scores, cells, keys=RM).select(*RM, "prob", "n", F.round("calibrated", 6).alias("calibrated"))


@query("c07_beta_calibration")
def c07(t):
    rows = pooled(t)
    return C.beta(rows, rows, keys=["entity_id"]).select("entity_id", "period_end", "y", "prob", "calibrated")


def months_of(t):
    """An entity's months in order: the hold-out is the last fifth of its calendar."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id")
    return pooled(t).withColumns({"position": F.row_number().over(w.orderBy("period_end")), "n": F.count(F.lit(1)).over(w)})


@query("c09_calibrator_comparison")
def c09(t):
    return C.compare_calibrators(months_of(t), ["entity_id"], minimum=12)


# Both calibrators of every run and model with the error that is left.
B.add("sigmoid_scores", f"""SELECT run_id, model, y, ROUND(COALESCE(1 / (1 + EXP(-(a * LN(q / (1 - q)) + b))), GREATEST(0.01, LEAST(0.99, prob))), 9) AS prob
 FROM (SELECT *, GREATEST(1e-6, LEAST(1 - 1e-6, prob)) AS q FROM scores) LEFT JOIN {SLOPE} USING (run_id, model)""")
B.add("isotonic_scores", "SELECT run_id, model, y, ROUND(calibrated, 9) AS prob FROM scores JOIN iso USING (run_id, model, prob)")
B.add("sigmoid_ece", ece_sql("sigmoid_scores", "run_id, model"))
B.add("isotonic_ece", ece_sql("isotonic_scores", "run_id, model"))
B.add("method_ece", "SELECT run_id, model, 'sigmoid' AS method, ece FROM sigmoid_ece UNION ALL SELECT run_id, model, 'isotonic', ece FROM isotonic_ece")


def method_ece(t):
    return C.method_errors(t.scores, t.scores, RM, ("sigmoid", "isotonic")).select(*RM, "method", F.round("ece", 9).alias("ece"))


B.add("deployed", """SELECT run_id, model, winner, CASE WHEN p IS NULL OR (p > 0 AND w < 0.9 * p) THEN winner ELSE 'sigmoid' END AS deployed, w, p FROM (
 SELECT run_id, model, FIRST(method ORDER BY ROUND(ece, 9), method) AS winner, MIN(ROUND(ece, 9)) AS w, MAX(ROUND(ece, 9)) FILTER (method = 'sigmoid') AS p FROM method_ece GROUP BY 1, 2)""")


@query("c10_deployment_rule", sql="SELECT run_id, model, winner, deployed, ROUND(w, 6) AS winner_ece, ROUND(p, 6) AS preferred_ece FROM deployed")
def c10(t):
    df = C.deployed_method(method_ece(t), RM)
    return df.select(*RM, "winner", "deployed", *r6(df, "winner_ece", "preferred_ece"))


def _cal(p):
    return f"1 / (1 + EXP(-(a * LN({p} / (1 - {p})) + b)))"


@query("c11_collapse_gate", sql=f"""SELECT run_id, model, ROUND(raw_max, 6) AS raw_max, ROUND(raw_median, 6) AS raw_median, ROUND(mid_04, 5) AS mid_04,
 COALESCE(cal_max < 0.10 OR cal_median < 0.25 * raw_median, FALSE) OR mid_04 < 0.15 AS rejected FROM (
 SELECT *, {_cal('LEAST(1 - 1e-6, raw_max)')} AS cal_max, {_cal('raw_median')} AS cal_median, {_cal('0.4')} AS mid_04 FROM {SLOPE} LEFT JOIN (
 SELECT run_id, model, MAX(prob) AS raw_max, MEDIAN(prob) AS raw_median FROM scores WHERE y = 1 GROUP BY 1, 2) USING (run_id, model))""")
def c11(t):
    gate = C.collapse_gate(t.scores.where("y = 1"), C.slope_intercept(t.scores, RM), RM)
    return gate.select(*RM, *r6(gate, "raw_max", "raw_median"), F.round("mid_04", 5).alias("mid_04"), "rejected")


@query("c12_diagnostics", sql=f"""SELECT run_id, model, ROUND(ece, 6) AS ece, n_samples, ROUND(a, 5) AS slope, ROUND(b, 5) AS intercept, ROUND(reliability, 6) AS reliability,
 ROUND(resolution, 6) AS resolution, ROUND(uncertainty, 6) AS uncertainty, ROUND(brier_total, 6) AS brier_total, (SELECT COUNT(*) FROM score_bins x WHERE x.run_id = e.run_id AND x.model = e.model) AS n_bins
FROM score_ece e JOIN {SLOPE} USING (run_id, model) JOIN score_brier USING (run_id, model)""")
def c12(t):
    df = C.diagnostics(t.scores, RM)
    return df.select(*RM, F.round("ece", 6).alias("ece"), "n_samples", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"),
                     *r6(df, "reliability", "resolution", "uncertainty", "brier_total"), F.size("bins").cast("bigint").alias("n_bins"))


@query("c13_winner_vs_deployed", sql="SELECT run_id, model, winner, deployed, winner = deployed AS agrees FROM deployed")
def c13(t):
    df = C.deployed_method(method_ece(t), RM)
    return df.select(*RM, "winner", "deployed", (F.col("winner") == F.col("deployed")).alias("agrees"))


# ---- uncertainty ----------------------------------------------------------------

REPS = 200


def _hash(text):
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def _tag(what):
    return f"concat_ws('|', '42', '{what}', entity_id, replicate, rn)"


B.add("boot", f"""SELECT entity_id, replicate, rn AS position, (st0 + rn - rn0) % n + 1 AS rn FROM (
 SELECT entity_id, replicate, rn, n, LAST_VALUE(CASE WHEN fresh THEN rn END IGNORE NULLS) OVER w AS rn0, LAST_VALUE(CASE WHEN fresh THEN st END IGNORE NULLS) OVER w AS st0 FROM (
 SELECT *, rn = 1 OR {_hash(_tag('r'))} % 12 = 0 AS fresh, {_hash(_tag('s'))} % n AS st FROM (SELECT entity_id, rn, n, UNNEST(range({REPS})) AS replicate FROM labelled_n))
 WINDOW w AS (PARTITION BY entity_id, replicate ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


def numbered(t):
    return U.numbered(labelled(t), ["entity_id"])


def draws(t):
    return U.bootstrap_indices(numbered(t), REPS)


@query("u01_bootstrap_indices", sql="SELECT entity_id, replicate, position, rn FROM boot")
def u01(t):
    return draws(t).select("entity_id", F.col("replicate").cast("bigint").alias("replicate"), F.col("position").cast("bigint").alias("position"), "rn")


@query("u02_bootstrap_interval", sql="""SELECT entity_id, rn, ROUND(AVG(v), 6) AS boot_mean, ROUND(STDDEV_POP(v), 5) AS boot_std, ROUND(QUANTILE_CONT(v, 0.05), 6) AS ci_lower,
 ROUND(QUANTILE_CONT(v, 0.95), 6) AS ci_upper FROM (SELECT b.entity_id, b.rn, 0.5 * n.ensemble + 0.5 * AVG(n.ensemble) OVER (PARTITION BY b.entity_id, b.replicate) AS v FROM boot b JOIN labelled_n n ON b.entity_id = n.entity_id AND b.rn = n.rn) GROUP BY 1, 2""")
def u02(t):
    from pyspark.sql import Window

    rows = numbered(t).select("entity_id", "rn", "ensemble")
    level = F.avg("ensemble").over(Window.partitionBy("entity_id", "replicate"))
    predicted = draws(t).join(rows, ["entity_id", "rn"]).withColumn("value", 0.5 * F.col("ensemble") + 0.5 * level)
    tail = 0.05
    out = predicted.groupBy("entity_id", "rn").agg(
        F.avg("value").alias("boot_mean"), F.stddev_pop("value").alias("boot_std"), F.percentile("value", tail).alias("ci_lower"), F.percentile("value", 1 - tail).alias("ci_upper"))
    return out.select("entity_id", F.col("rn").cast("bigint").alias("rn"), F.round("boot_mean", 6).alias("boot_mean"), F.round("boot_std", 5).alias("boot_std"), *r6(out, "ci_lower", "ci_upper"))


def history(t):
    df = numbered(t)
    return df.withColumn("cut", F.floor(F.col("n") * 0.8))


def train_rows(t):
    return U.numbered(history(t).where("rn <= cut").select("entity_id", "period_end", F.col("ensemble").alias("prob"), "y"), ["entity_id"])


def test_rows(t):
    return history(t).where("rn > cut").select("entity_id", "period_end", F.col("ensemble").alias("prob"), "m1", "m2", "m3")


def bands(t):
    train = train_rows(t)
    boot = U.calibrator_bootstrap(train, U.bootstrap_indices(train, REPS), test_rows(t), ["entity_id"])
    mean = (F.col("m1") + F.col("m2") + F.col("m3")) / 3
    var = sum((F.pow(F.col(m) - mean, 2) for m in ("m1", "m2", "m3")), F.lit(0.0)) / 3
    return U.final_band(boot.withColumn("member_std", F.sqrt(var)))


@query("u03_calibrator_bootstrap")
def u03(t):
    return bands(t).select("entity_id", "period_end", "prob", "boot_mean", "boot_std", "ci_lower", "ci_upper")


# A band with an exact oracle: percentiles and deviations of the members stand in for the replicates.
B.add("member_band", """SELECT entity_id, period_end, y, ensemble AS prob, (m1 + m2 + m3) / 3 AS boot_mean,
 LEAST(m1, m2, m3) * 0.9 + 0.1 * ensemble AS raw_lower, GREATEST(m1, m2, m3) * 0.05 + 0.95 * ensemble AS raw_upper,
 SQRT((POW(m1 - ensemble, 2) + POW(m2 - ensemble, 2) + POW(m3 - ensemble, 2)) / 3) AS member_std FROM labelled""")
B.add("final_band", """SELECT entity_id, period_end, y, prob,
 CASE WHEN w > hi - lo AND hi >= 0.999 AND lo > 0.001 THEN GREATEST(lo - (w - hi + lo), 0) WHEN w > hi - lo AND hi < 0.999 AND lo > 0.001 THEN GREATEST(lo - (w - hi + lo) / 2, 0) ELSE lo END AS ci_lower,
 CASE WHEN w > hi - lo AND lo <= 0.001 AND hi < 0.999 THEN LEAST(hi + (w - hi + lo), 1) WHEN w > hi - lo AND hi < 0.999 AND lo > 0.001 THEN LEAST(hi + (w - hi + lo) / 2, 1) ELSE hi END AS ci_upper FROM (
 SELECT *, LEAST(GREATEST(0, LEAST(1, l)), hi) AS lo FROM (SELECT *, LEAST(raw_lower, boot_mean - 1.645 * 0.3 * member_std, boot_mean - w / 2) AS l,
 GREATEST(0, LEAST(1, GREATEST(raw_upper, boot_mean + 1.645 * 0.3 * member_std, boot_mean + w / 2))) AS hi FROM (SELECT *, GREATEST(0.06, 2.0 * member_std) AS w FROM member_band)))""")


def member_bands(t):
    m = [F.col(c) for c in ("m1", "m2", "m3")]
    var = sum((F.pow(x - F.col("ensemble"), 2) for x in m), F.lit(0.0)) / 3
    base = labelled(t).select(
        "entity_id", "period_end", "y", F.col("ensemble").alias("prob"), ((m[0] + m[1] + m[2]) / 3).alias("boot_mean"),
        (F.least(*m) * 0.9 + 0.1 * F.col("ensemble")).alias("raw_lower"), (F.greatest(*m) * 0.05 + 0.95 * F.col("ensemble")).alias("raw_upper"), F.sqrt(var).alias("member_std"))
    return U.final_band(base.withColumn("boot_std", 0.3 * F.col("member_std")))


@query("u04_interval", sql="SELECT entity_id, period_end, ROUND(ci_lower, 6) AS ci_lower, ROUND(ci_upper, 6) AS ci_upper FROM final_band")
def u04(t):
    df = member_bands(t)
    return df.select("entity_id", "period_end", *r6(df, "ci_lower", "ci_upper"))


MIX = {"m1": 0.5, "m2": 0.3, "m3": 0.2}
_DRAWS = B.values("w", "w1, w2, w3", [tuple(float(x) for x in r) for r in U.dirichlet_draws(MIX)])


@query("u05_weight_perturbation", sql=f"""SELECT entity_id, period_end, ROUND(ensemble, 6) AS ensemble, ROUND(AVG(v), 6) AS boot_mean, ROUND(STDDEV_POP(v), 6) AS boot_std, ROUND(QUANTILE_CONT(v, 0.05), 6) AS ci_lower,
 ROUND(QUANTILE_CONT(v, 0.95), 6) AS ci_upper FROM (SELECT entity_id, period_end, ensemble, w1 * m1 + w2 * m2 + w3 * m3 AS v FROM labelled, ({_DRAWS})) GROUP BY 1, 2, ensemble""")
def u05(t):
    df = U.weight_perturbation(labelled(t), MIX, ["entity_id", "period_end", "ensemble"])
    return df.select("entity_id", "period_end", *r6(df, "ensemble", "boot_mean", "boot_std", "ci_lower", "ci_upper"))


@query("u06_fallback_rule", sql="""SELECT entity_id, CASE WHEN n < 24 OR p = 0 OR p = n THEN 'dirichlet' ELSE 'block_bootstrap' END AS method,
 CASE WHEN n < 24 OR p = 0 OR p = n THEN 'insufficient history' END AS reason FROM (SELECT entity_id, COUNT(*) AS n, SUM(y) AS p FROM labelled_n GROUP BY 1)""")
def u06(t):
    return U.bootstrap_method(numbered(t), ["entity_id"])


B.add("coverage", f"""SELECT *, width >= 0.05 AND (has_mean OR has_rate) AS covered FROM (SELECT *, ci_upper - ci_lower AS width, ci_lower <= prob AND prob <= ci_upper AS has_mean, ci_lower <= rate AND rate <= ci_upper AS has_rate FROM (
 SELECT *, AVG(y) OVER {B.over('ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING', 'entity_id')} AS rate FROM final_band))""")


@query("u07_coverage_summary", sql="""SELECT entity_id, COUNT(*) AS n, COUNT(*) FILTER (width >= 0.05) AS wide_rows, ROUND(AVG(CAST(covered AS INT)), 6) AS covered_share, ROUND(AVG(CAST(has_mean AS INT)), 6) AS mean_share,
 ROUND(AVG(CAST(has_rate AS INT)), 6) AS rate_share, ROUND(AVG(width), 6) AS mean_width, ROUND(MEDIAN(width), 6) AS median_width FROM coverage GROUP BY 1""")
def u07(t):
    df = U.coverage_summary(U.with_coverage(member_bands(t), ["entity_id"]), ["entity_id"])
    return df.select("entity_id", "n", "wide_rows", *r6(df, "covered_share", "mean_share", "rate_share", "mean_width", "median_width"))


@query("u08_coverage_at_origins", sql="""SELECT origin, COUNT(*) AS in_window, COUNT(*) FILTER (covered) AS n_covered FROM coverage JOIN origins ON period_end = origin GROUP BY 1""")
def u08(t):
    rows = U.with_coverage(member_bands(t), ["entity_id"])
    return rows.join(t.origins, F.col("period_end") == F.col("origin")).groupBy("origin").agg(
        F.count(F.lit(1)).alias("in_window"), F.count_if("covered").alias("n_covered"))


# ---- named transforms of the bootstrap -------------------------------------------


@query("r03_pluggable_predictor", sql="""SELECT entity_id, rn, ROUND(AVG(v), 6) AS boot_mean, ROUND(STDDEV_POP(v), 5) AS boot_std, ROUND(QUANTILE_CONT(v, 0.05), 6) AS ci_lower,
 ROUND(QUANTILE_CONT(v, 0.95), 6) AS ci_upper FROM (SELECT b.entity_id, b.rn, 0.5 * n.ensemble + 0.5 * AVG(n.ensemble) OVER (PARTITION BY b.entity_id, b.replicate) AS v FROM boot b JOIN labelled_n n ON b.entity_id = n.entity_id AND b.rn = n.rn) GROUP BY 1, 2""")
def r03(t):
    rows = numbered(t).select("entity_id", "rn", F.col("ensemble").alias("prob"), "y")
    out = U.predictor_interval(draws(t), rows, ["entity_id"], lambda pdf: 0.5 * pdf["prob"] + 0.5 * pdf["prob"].mean())
    return out.select("entity_id", F.col("rn").cast("bigint").alias("rn"), F.round("boot_mean", 6).alias("boot_mean"), F.round("boot_std", 5).alias("boot_std"), *r6(out, "ci_lower", "ci_upper"))


def last_rows(t, k):
    from pyspark.sql import Window

    newest = Window.partitionBy("entity_id", "model").orderBy(F.col("period_end").desc())
    return t.score_panel.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= k)


__all__ = ["W", "last_rows"]
