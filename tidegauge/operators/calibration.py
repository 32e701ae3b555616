"""Reliability, calibration error, and calibrators fitted for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ordered import exact_quantiles, score_cells
from tidegauge.functions.scalars import clip, logit, sigmoid
from tidegauge.operators import isotonic as monotone
from tidegauge.operators import keyed_logit
from tidegauge.session import durable

EDGE_EPS = 1e-12
LOGIT_EPS = 1e-6
DIGITS = 9


def _cells(scores: DataFrame, keys: list[str]) -> DataFrame:
    return score_cells(scores, keys).withColumn("n", F.col("tp") + F.col("fp"))


def reliability(scores: DataFrame, keys: list[str], n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Observed frequency and mean score per bin. Equal quantile edges merge, empty bins vanish."""
    cells = _cells(scores, keys)
    if strategy == "quantile":
        edges = exact_quantiles(cells, keys, [i / n_bins for i in range(n_bins + 1)])
        unique = F.array_distinct(F.transform("q", lambda e: F.round(e, DIGITS)))
        binned = cells.join(edges.select(*keys, unique.alias("e")), keys)
    else:
        binned = cells.withColumn("e", F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)]))
    p = F.round("prob", DIGITS)
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    b = F.size(F.filter(inner, lambda e: e <= p))
    low, high = F.element_at("e", F.col("bin") + 1), F.element_at("e", F.least(F.col("bin") + 2, F.size("e")))
    return (
        binned.withColumn("bin", b).withColumn("centre", (low + high) / 2)
        .groupBy(*keys, "bin").agg(
            F.max("centre").alias("centre"), (F.sum("tp") / F.sum("n")).alias("observed"),
            (F.sum(F.col("prob") * F.col("n")) / F.sum("n")).alias("predicted"), F.sum("n").alias("n"))
    )


def equal_width_bin(p: str = "prob", n_bins: int = 10) -> Column:
    """Bin number as the count of inner edges i * (1 / n) that do not exceed the score."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    total = F.lit(0)
    for e in edges:
        total = total + F.when(F.col(p) >= e, 1).otherwise(0)
    return total


def calibration_error(scores: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    cells = _cells(scores, keys)
    bins = cells.groupBy(*keys, equal_width_bin("prob", n_bins).alias("bin")).agg(
        F.sum("n").alias("n"), (F.sum("tp") / F.sum("n")).alias("o"), (F.sum(F.col("prob") * F.col("n")) / F.sum("n")).alias("p"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("o") - F.col("p"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n_samples"))


def brier_parts(scores: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Reliability - resolution + uncertainty on quantile bins."""
    bins = reliability(scores, keys, n_bins)
    n, o, p = F.col("n").cast("double"), F.col("observed"), F.col("predicted")
    base = F.sum(n * o) / F.sum(n)
    sums = bins.groupBy(*keys).agg(
        base.alias("b"), (F.sum(n * F.pow(p - o, 2)) / F.sum(n)).alias("reliability"),
        (F.sum(n * o * o) / F.sum(n) - F.pow(base, 2)).alias("resolution"))
    unc = F.col("b") * (1 - F.col("b"))
    return sums.select(*keys, "reliability", "resolution", unc.alias("uncertainty"), (F.col("reliability") - F.col("resolution") + unc).alias("brier_total"))


def slope_intercept(scores: DataFrame, keys: list[str], most_steps: int = 40, tolerance: float = 1e-9, weight: str | None = None) -> DataFrame:
    """Unpenalised logistic fit of the label on logit(score), for every key at once.

    Each Newton step is one aggregation of five sums per key and a 2 x 2 solve, on
    distinct scores that are written once; the small coefficient table is written after
    every step, so that its size is known to the join. Steps go on until the largest is
    within the tolerance; ``converged`` says so per key. One-class keys have no row.
    """
    if weight:
        cells = scores.groupBy(*keys, "prob").agg(
            F.sum(F.when(F.col("y") == 1.0, F.col(weight)).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("y") == 1.0, 0.0).otherwise(F.col(weight))).alias("fp"))
    else:
        cells = score_cells(scores, keys)
    data = durable(cells.select(
        *keys, logit("prob", LOGIT_EPS).alias("x"), (F.col("tp") + F.col("fp")).cast("double").alias("n"), F.col("tp").cast("double").alias("t")))
    coef = data.groupBy(*keys).agg(F.sum("t").alias("_p"), F.sum("n").alias("_n")).where("_p > 0 and _p < _n").select(
        *keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    x, n = F.col("x"), F.col("n")
    for _ in range(most_steps):
        mu = sigmoid(F.col("a") * x + F.col("b"))
        w, r = n * mu * (1 - mu), F.col("t") - n * mu
        sums = data.join(coef, keys).groupBy(*keys, "a", "b").agg(
            F.sum(r * x).alias("ga"), F.sum(r).alias("gb"), F.sum(w * x * x).alias("h11"), F.sum(w * x).alias("h12"), F.sum(w).alias("h22"))
        det = F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12")
        da = F.try_divide(F.col("h22") * F.col("ga") - F.col("h12") * F.col("gb"), det)
        db = F.try_divide(F.col("h11") * F.col("gb") - F.col("h12") * F.col("ga"), det)
        da, db = F.coalesce(da, F.lit(0.0)), F.coalesce(db, F.lit(0.0))
        # a step over 5 is halved until it is not: far from the solution, Newton steps overshoot
        size = F.greatest(F.abs(da), F.abs(db))
        shrink = F.when(size > 5.0, F.pow(F.lit(0.5), F.ceil(F.log2(size / 5.0)))).otherwise(1.0)
        coef = durable(sums.select(*keys, (F.col("a") + shrink * da).alias("a"), (F.col("b") + shrink * db).alias("b"), (size <= tolerance * F.greatest(F.lit(1.0), F.abs("a"), F.abs("b"))).alias("converged")))
        if coef.where("not converged").isEmpty():
            break
    return coef.withColumnsRenamed({"a": "slope", "b": "intercept"})


def apply_sigmoid(scores: DataFrame, coef: DataFrame, keys: list[str], name: str = "calibrated") -> DataFrame:
    """Platt map on logit(score); scores of keys without a fit are only clipped."""
    fitted = sigmoid(F.col("slope") * logit("prob", LOGIT_EPS) + F.col("intercept"))
    return scores.join(coef, keys, "left").withColumn(name, F.coalesce(fitted, clip("prob", 0.01, 0.99))).drop("slope", "intercept", "converged")


def _keyed(keys: list[str], *frames: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """Fits without a key get one for all rows."""
    return (list(keys), list(frames)) if keys else (["_all"], [f.withColumn("_all", F.lit(0)) for f in frames])


def isotonic(train: DataFrame, target: DataFrame, name: str = "calibrated", keys: list[str] = ()) -> DataFrame:
    """Monotone map of each key, fitted on distinct scores with their counts, clipped to [0.01, 0.99]."""
    keys, (train, target) = _keyed(keys, train, target)
    return monotone.apply(target, monotone.blocks(train, keys), keys, name).drop("_all")


def beta(train: DataFrame, target: DataFrame, name: str = "calibrated", eps: float = LOGIT_EPS, keys: list[str] = ()) -> DataFrame:
    """Logistic of each key on ln p and -ln(1 - p); a negative coefficient is dropped and the other one fitted alone.

    The three fits (both terms, one of them) are one keyed fit. Scores of one-class keys are clipped only.
    """
    keys, (train, target) = _keyed(keys, train, target)

    def terms(df):
        q = clip("prob", eps, 1 - eps)
        return df.withColumns({"_lp": F.ln(q), "_lq": -F.ln(1 - q)})

    count = lambda c: F.col(c).cast("double").alias("_weight")
    cells = terms(_cells(train, keys)).select(*keys, "_lp", "_lq", F.inline(F.array(
        F.struct(F.lit(1.0).alias("_label"), count("tp")), F.struct(F.lit(0.0).alias("_label"), count("fp"))))).where("_weight > 0")
    uses = F.array(*[F.struct(F.lit(v).alias("_use"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for v, a, b in (("both", 1.0, 1.0), ("lp", 1.0, 0.0), ("lq", 0.0, 1.0))])
    each = cells.select("*", F.inline(uses)).withColumns({"_lp": F.col("_lp") * F.col("_a"), "_lq": F.col("_lq") * F.col("_b")})
    fits = keyed_logit.fit(each, [*keys, "_use"], ["_lp", "_lq"], y="_label", weight="_weight", l2=0.0, most_steps=60)
    of = lambda use: F.max(F.when(F.col("_use") == use, F.col("coef")))
    wide = fits.groupBy(*keys).agg(of("both").alias("_both"), of("lp").alias("_p"), of("lq").alias("_q"))
    chosen = F.when(F.col("_both")[1] < 0, F.col("_q")).when(F.col("_both")[2] < 0, F.col("_p")).otherwise(F.col("_both"))
    scored = keyed_logit.score(terms(target), wide.select(*keys, chosen.alias("coef")), keys, ["_lp", "_lq"], "_beta")
    return scored.withColumn(name, F.coalesce(clip("_beta", 0.0, 1.0), clip("prob", 0.01, 0.99))).drop("_beta", "_lp", "_lq", "_all")


def sigmoid_map(train: DataFrame, target: DataFrame, name: str = "calibrated", keys: list[str] = ()) -> DataFrame:
    keys, (train, target) = _keyed(keys, train, target)
    return apply_sigmoid(target, slope_intercept(train, keys), keys, name).drop("_all")


CALIBRATORS = {"isotonic": isotonic, "beta": beta, "sigmoid": sigmoid_map}


def method_errors(train: DataFrame, test: DataFrame, keys: list[str], methods=("isotonic", "sigmoid", "beta")) -> DataFrame:
    """(keys, method, ece, n_samples): every calibrator fitted per key on ``train``, its error on ``test``."""
    parts = [
        CALIBRATORS[m](train, test, keys=keys).select(*keys, F.lit(m).alias("method"), "y", F.round("calibrated", DIGITS).alias("prob")) for m in methods]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return calibration_error(union, [*keys, "method"])


def compare_calibrators(rows: DataFrame, keys: list[str], share: float = 0.2, minimum: int = 20, methods=("isotonic", "sigmoid", "beta")) -> DataFrame:
    """Hold out the last part of each key's out-of-fold rows; ECE per method, lowest wins.

    ``rows`` carries ``position`` (1..n in time order), ``n``, ``prob`` and ``y``.
    """
    held = F.least(F.greatest(F.round(F.col("n") * share), F.lit(minimum)), F.greatest(F.col("n") - minimum, F.lit(1)))
    split = durable(rows.withColumn("_hold", F.col("position") > F.col("n") - held))
    ece = method_errors(split.where(~F.col("_hold")), split.where("_hold"), keys, methods)
    best = ece.groupBy(*keys).agg(F.min_by("method", F.struct(F.round("ece", DIGITS), "method")).alias("_best"))
    return ece.join(best, keys).withColumn("is_winner", F.col("method") == F.col("_best")).drop("_best")


def deployed_method(table: DataFrame, keys: list[str], preferred: str = "sigmoid") -> DataFrame:
    """Keep the preferred calibrator unless the winner's error is more than 10 % lower."""
    best = table.groupBy(*keys).agg(
        F.min_by("method", F.struct("ece", "method")).alias("winner"), F.min("ece").alias("winner_ece"),
        F.max(F.when(F.col("method") == preferred, F.col("ece"))).alias("preferred_ece"))
    switch = F.col("preferred_ece").isNull() | ((F.col("preferred_ece") > 0) & (F.col("winner_ece") < 0.9 * F.col("preferred_ece")))
    return best.withColumn("deployed", F.when(switch, F.col("winner")).otherwise(F.lit(preferred)))


def collapse_gate(positives: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    """Reject a sigmoid that erases the signal: probes are the positives' maximum and median and 0.3 / 0.4 / 0.5."""
    counts = positives.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(counts, keys, [0.5, 1.0]).select(*keys, F.col("q")[0].alias("raw_median"), F.col("q")[1].alias("raw_max"))
    cal = lambda p: sigmoid(F.col("slope") * logit(p, LOGIT_EPS) + F.col("intercept"))
    out = coef.join(med, keys, "left").withColumns({
        "cal_max": cal(F.col("raw_max")), "cal_median": cal(F.col("raw_median")), "mid_03": cal(F.lit(0.3)), "mid_04": cal(F.lit(0.4)), "mid_05": cal(F.lit(0.5))})
    positive = F.coalesce((F.col("cal_max") < 0.10) | (F.col("cal_median") < 0.25 * F.col("raw_median")), F.lit(False))
    return out.withColumn("rejected", positive | (F.col("mid_04") < 0.15))


def diagnostics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: ECE, slope, intercept, Brier parts, sample size, reliability bins."""
    bins = reliability(scores, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("bin", "centre", "observed", "predicted", "n"))).alias("bins"))
    return (
        calibration_error(scores, keys).join(slope_intercept(scores, keys), keys, "left")
        .join(brier_parts(scores, keys), keys).join(bins, keys)
    )
