"""Backtests under the information sets of past dates, and the threshold stability gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.ordered import cumulate_small, score_cells
from tidegauge.functions.scalars import shift_months
from tidegauge.operators import align, features, keyed_logit, metrics

DAYS_PER_MONTH = 30.44
STABLE_WITHIN, REGRESSION_TOLERANCE = 1.0, 2.0


def lead(first_event: Column, first_signal: Column) -> Column:
    return F.datediff(first_event, first_signal) / F.lit(DAYS_PER_MONTH)


# ---- real-time frames -------------------------------------------------------------


def realtime_features(panel: DataFrame, origins: DataFrame, lags: DataFrame) -> DataFrame:
    """Per-series features as they looked at each origin: trim, mask, transform with the origin as a key."""
    masked = align.lag_mask(align.as_of(panel, origins), lags, keys=["origin", *align.KEYS])
    return features.standard_transforms(masked, keys=("origin",))


def realtime_features_shared(panel: DataFrame, origins: DataFrame, lags: DataFrame, default_lag: int = 1) -> DataFrame:
    """Same rows, but history is transformed once.

    The mask only touches as many last rows as the longest lag and the transforms look back at most
    ``features.REACH`` rows, so only the tail of each origin is windowed again. The longest lag is read from ``lags``.
    """
    max_lag = max(default_lag, lags.agg(F.max("lag_months")).first()[0] or 0)
    reach = features.REACH
    history = align.as_of(features.standard_transforms(panel), origins)
    old = history.where(F.col("period_end") <= shift_months("origin", -max_lag))
    masked = align.lag_mask(
        align.as_of(panel, origins).where(F.col("period_end") > shift_months("origin", -(max_lag + reach))), lags, keys=["origin", *align.KEYS])
    fresh = features.standard_transforms(masked, keys=("origin",)).where(F.col("period_end") > shift_months("origin", -max_lag))
    cols = ["origin", "entity_id", "feature", "period_end", "value"]
    return old.select(*cols).unionByName(fresh.select(*cols))


def strict_frames(frame: DataFrame, horizon: int) -> DataFrame:
    """Training rows whose label was observable at the origin, and the one row to predict."""
    known = (F.col("period_end") <= shift_months("origin", -horizon)) & F.col("y").isNotNull()
    role = F.when(known, "train").when(F.col("period_end") == F.col("origin"), "predict")
    return frame.withColumn("role", role).where("role is not null")


def model_frame(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Small wide feature set of a real-time panel, gaps carried forward before any row is cut out."""
    w = W.series_window(*keys)
    parts = panel.withColumns({"yoy": W.pct_change("value", 12, w), "ma3": W.rolling_mean("value", 3, w, 1), "z": W.expanding_z("value", w, 12)})
    at = lambda s, c: F.max(F.when(F.col("series_id") == s, F.col(c)))
    wide = parts.groupBy(*keys, "entity_id", "period_end").agg(
        at("revenue", "yoy").alias("x_revenue"), at("orders", "z").alias("x_orders"), at("avg_price", "z").alias("x_price"),
        at("urgent_share", "ma3").alias("x_urgent"), at("failed_share", "ma3").alias("x_failed"))
    we = W.by(*keys, "entity_id")
    return wide.select(*keys, "entity_id", "period_end", *[F.coalesce(W.ffill(c, we), F.lit(0.0)).alias(c) for c in MODEL_FEATURES])


MODEL_FEATURES = ["x_revenue", "x_orders", "x_price", "x_urgent", "x_failed"]


def origin_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and metrics over origins per candidate, on rows with an outcome and a score."""
    valid = results.where("actual is not null and prob is not null")
    ranked = metrics.metrics_table(valid.withColumn("y", F.col("actual")), keys)
    hit = lambda a, s: F.count_if((F.col("actual") == a) & (F.col("signal") == s))
    counts = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origins_tested"), F.sum("actual").cast("bigint").alias("positive_origins"), F.avg("signal").alias("signal_rate"),
        F.avg("threshold").alias("mean_threshold"), F.avg("train_rows").alias("mean_train_rows"),
        hit(1, 1).alias("n_tp"), hit(0, 1).alias("n_fp"), hit(1, 0).alias("n_fn"), hit(0, 0).alias("n_tn")).withColumns(metrics.rates())
    return counts.join(ranked.select(*keys, "auc", "pr_auc", "brier", "log_loss"), keys)


def rank_candidates(summary: DataFrame, partition: list[str] = (), name: str = "candidate_id") -> DataFrame:
    """PR-AUC, then Brier, F1, AUC, precision, vintage error; NULLs last, names break ties."""
    d = lambda c: F.round(F.col(c), 9).desc_nulls_last()
    order = [d("pr_auc"), F.round("brier", 9).asc_nulls_last(), d("f1"), d("auc"), d("precision")]
    if "vintage_mae" in summary.columns:
        order.append(F.round("vintage_mae", 9).asc_nulls_last())
    w = Window.partitionBy(*(partition or [F.lit("all")])).orderBy(*order, name)
    return summary.withColumn("rank", F.row_number().over(w))


# ---- event windows ------------------------------------------------------------------


def event_windows(flags: DataFrame, before: int = 12, keys: list[str] = ["entity_id"]) -> DataFrame:
    """One test window per contiguous event: from ``before`` months ahead of it to its end."""
    marked = W.with_islands(flags, F.col("flag"), W.by(*keys))
    spans = marked.where("flag = 1.0").groupBy(*keys, "island").agg(F.min("period_end").alias("start_month"), F.max("period_end").alias("end_month"))
    return spans.select(*keys, F.date_format("start_month", "yyyy-MM").alias("event"), shift_months("start_month", -before).alias("train_end"), "start_month", "end_month")


def window_months(windows: DataFrame) -> DataFrame:
    """Windows with one row per test month, so that they are joined by equality."""
    months = F.sequence(F.date_add("train_end", 1), F.col("end_month"), F.expr("interval 1 month"))
    return windows.where("train_end < end_month").withColumn("_m", F.explode(months)).withColumn("period_end", F.last_day("_m")).drop("_m")


def event_results(scores: DataFrame, windows: DataFrame, keys: list[str], fixed: float, threshold: str = "threshold", trajectory: bool = False) -> DataFrame:
    """Per (key, event): peak, first crossing and lead at the run's own and at a fixed threshold, AUC, Brier.

    ``scores`` carries keys, entity_id, period_end, prob, y and the own threshold. Scores that belong to one event carry it and
    meet its window by month; others meet the windows of their entity, with the window as a filter.
    """
    if "event" in scores.columns:
        test = scores.join(window_months(windows), ["entity_id", "period_end", "event"])
    else:
        test = scores.join(windows, "entity_id").where((F.col("period_end") > F.col("train_end")) & (F.col("period_end") <= F.col("end_month")))
    group = [*keys, "entity_id", "event"]
    first = lambda cond: W.first_date_where(cond)
    own, at_fixed, positive = F.col("prob") >= F.col(threshold), F.col("prob") >= fixed, F.col("y") == 1.0
    aggs = [
        F.max("train_end").alias("train_end"), F.count(F.lit(1)).alias("test_months"), F.sum("y").cast("bigint").alias("event_months"),
        F.max("prob").alias("peak_prob"), F.max_by("period_end", F.struct("prob", -F.datediff("period_end", F.lit("1970-01-01").cast("date")))).alias("peak_date"),
        F.max(threshold).alias("threshold"), F.bool_or(own).alias("crossed"), F.bool_or(at_fixed).alias("crossed_fixed"),
        first(positive).alias("first_event"), first(own).alias("first_signal"), first(at_fixed).alias("first_signal_fixed")]
    if trajectory:
        aggs += [F.sort_array(F.collect_list(F.struct("period_end", "prob"))).alias("trajectory"), F.sort_array(F.collect_list(F.struct("period_end", "y"))).alias("actual")]
    rows = test.groupBy(*group).agg(*aggs).withColumns({
        "lead_months": lead(F.col("first_event"), F.col("first_signal")), "lead_months_fixed": lead(F.col("first_event"), F.col("first_signal_fixed")), "fixed_threshold": F.lit(fixed)})
    ranked = cumulate_small(score_cells(test, group), group, metrics.COUNTS)
    named = {**metrics.rank_aggregates(), **metrics.loss_aggregates()}
    quality = ranked.groupBy(*group).agg(*[named[n].alias(n) for n in ("auc", "brier")])
    return rows.join(quality, group, "left")


def member_peaks(scores: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    inside = (F.col("period_end") > F.col("train_end")) & (F.col("period_end") <= F.col("end_month"))
    return scores.join(windows, "entity_id").where(inside).groupBy(*keys, "entity_id", "event").agg(F.max("prob").alias("peak_prob"))


def backtest_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    crossed = F.col("crossed")
    return rows.where("auc is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events_tested"), F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"),
        F.avg("brier").alias("mean_brier"), F.avg("peak_prob").alias("mean_peak"), F.count_if(crossed).alias("detected"),
        F.avg("lead_months_fixed").alias("mean_lead_fixed"), F.avg("lead_months").alias("mean_lead"),
        F.coalesce(F.avg(F.when(crossed, F.col("lead_months"))), F.lit(0.0)).alias("mean_lead_detected"))


def by_scope(rows: DataFrame, in_scope: Column) -> DataFrame:
    """Every row counts in the full history, and once more where it is in scope."""
    scopes = F.array_compact(F.array(F.lit("full_history"), F.when(in_scope, F.lit("in_scope"))))
    return rows.withColumn("scope", F.explode(scopes))


# ---- gaps between information sets ----------------------------------------------------


def gap_summary(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    gap = F.col(a) - F.col(b)
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mean_abs"), F.avg(gap).alias("mean_signed"), F.max(F.abs(gap)).alias("max_abs"), F.stddev_pop(gap).alias("std"))


def scenario_table(results: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Scenarios side by side with pairwise gaps and signals."""
    at = lambda s: F.max(F.when(F.col("scenario") == s, F.col("prob")))
    wide = results.groupBy(*keys).agg(*[at(s).alias(f"prob_{s}") for s in ("revised", "simulated", "vintage")])
    gap = lambda a, b: F.col(f"prob_{a}") - F.col(f"prob_{b}")
    return wide.withColumns({
        "gap_vintage_vs_simulated": gap("vintage", "simulated"), "gap_vintage_vs_revised": gap("vintage", "revised"), "gap_simulated_vs_revised": gap("simulated", "revised"),
        "signal_vintage": (F.col("prob_vintage") >= threshold).cast("int"), "signal_simulated": (F.col("prob_simulated") >= threshold).cast("int"),
        "status": F.when(F.col("prob_vintage").isNotNull() & F.col("prob_simulated").isNotNull(), "ok").otherwise("incomplete")})


def replay_statistics(replay: DataFrame, keys: list[str]) -> DataFrame:
    g = F.col("gap_vintage_vs_simulated")
    key = F.struct(F.round(F.abs(g), 9), -F.datediff("origin", F.lit("1970-01-01").cast("date")))
    return replay.where("prob_vintage is not null and prob_simulated is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_origins"), F.avg(F.abs(g)).alias("mean_abs_gap"), F.avg(g).alias("mean_signed_gap"), F.max(F.abs(g)).alias("max_abs_gap"),
        F.max_by("origin", key).alias("max_gap_origin"), F.stddev_pop(g).alias("std_gap"), F.avg(F.abs("gap_vintage_vs_revised")).alias("mean_abs_vs_revised"),
        F.avg(F.abs("gap_simulated_vs_revised")).alias("mean_abs_simulated_vs_revised"))


def replay_verdict(stats: DataFrame) -> DataFrame:
    """``stats`` carries mean_abs_gap, max_abs_gap and n_flips."""
    m, x, flips = F.col("mean_abs_gap"), F.col("max_abs_gap"), F.col("n_flips")
    advice = F.when(m < 0.015, "keep_simulation").when((m > 0.03) | (x > 0.10), "switch_to_vintage_for_strict_search").otherwise("mixed")
    keep = (m > 0.03) | (x > 0.10) | (flips > 0)
    return stats.withColumns({
        "recommendation": F.coalesce(F.when(m.isNotNull(), advice), F.lit("mixed")),
        "verdict": F.when(m.isNull(), "NEEDS-WORK").when(keep, "KEEP").when((m < 0.015) & (flips == 0), "DISCARD").otherwise("NEEDS-WORK")})


# ---- threshold stability ---------------------------------------------------------------

TRAJECTORY = "array<struct<period_end: date, prob: double>>"


def parse_trajectory(rows: DataFrame, text: str, name: str = "trajectory") -> DataFrame:
    return rows.withColumn(name, F.from_json(text, TRAJECTORY))


def rescore(rows: DataFrame, fixed: float) -> DataFrame:
    """Crossing and lead at a fixed threshold: exact from a trajectory, bounded without one."""
    hit = F.filter("trajectory", lambda x: x["prob"] >= fixed)
    first_cross = F.array_min(F.transform(hit, lambda x: x["period_end"]))
    first_event = F.array_min(F.transform(F.filter("actual", lambda x: x["y"] == 1.0), lambda x: x["period_end"]))
    has, peak, own_lead, own = F.col("trajectory").isNotNull(), F.col("peak_prob"), F.col("lead_months"), F.col("threshold")
    method = (
        F.when(peak.isNull(), "unavailable").when(has & first_cross.isNull(), "exact_no_cross").when(has, "exact").when(peak < fixed, "exact_no_cross")
        .when(own_lead.isNull(), "bound_unknown").when(own.isNull() | (own >= fixed), "bound_at_or_earlier").otherwise("bound_at_or_later"))
    lead_fixed = F.when(F.col("method") == "exact", lead(first_event, first_cross)).when(F.col("method").startswith("bound_at"), own_lead)
    out = rows.withColumn("method", method).withColumn("lead_fixed", lead_fixed)
    return out.withColumns({"crossed_fixed": peak >= fixed, "threshold_shift": own - fixed, "lead_delta_fixed": F.col("lead_fixed") - own_lead, "fixed_threshold": F.lit(fixed)})


def lead_matrix(challenger: DataFrame, baseline: DataFrame, event: list[str], stable: float = STABLE_WITHIN) -> DataFrame:
    """Challenger against baseline per shared event, at own thresholds and at the baseline's."""
    b = baseline.select(*event, F.col("lead_months").alias("baseline_lead"), F.col("threshold").alias("baseline_threshold"), F.col("peak_prob").alias("baseline_peak"))
    c, near = challenger.join(b, event), F.abs(F.col("lead_months") - F.col("lead_fixed")) <= stable
    return c.withColumns({
        "lead_delta_own": F.col("lead_months") - F.col("baseline_lead"), "lead_delta_vs_baseline": F.col("lead_fixed") - F.col("baseline_lead"),
        "stable": F.coalesce(near, F.lit(False))})


def stability_gate(matrix: DataFrame, keys: list[str], everyone: DataFrame | None = None, tolerance: float = REGRESSION_TOLERANCE) -> DataFrame:
    """Fails when an in-scope event loses more than the tolerance. Unknown deltas are counted only.

    An experiment without a single row fails; such experiments come from ``everyone``.
    """
    d, scoped = F.col("lead_delta_vs_baseline"), F.col("in_scope")
    bad = scoped & (d < -tolerance)
    out = matrix.groupBy(*keys).agg(
        F.count_if(scoped).alias("n_events"), F.count_if(scoped & d.isNull()).alias("n_unknown"), F.count_if(bad).alias("n_violations"),
        F.sort_array(F.collect_list(F.when(bad, F.struct("event", "lead_delta_vs_baseline")))).alias("violations"))
    if everyone is not None:
        out = everyone.join(out, keys, "left")
    return out.withColumn("passed", F.coalesce(F.col("n_violations") == 0, F.lit(False)))


def baseline_threshold(runs: DataFrame) -> DataFrame:
    """The threshold of the run marked as baseline; the job stops when there is none."""
    chosen = runs.where("is_baseline").agg(F.max_by("threshold", "run_id").alias("threshold"))
    return chosen.select(F.when(F.col("threshold").isNull(), F.raise_error(F.lit("no baseline run"))).otherwise(F.col("threshold")).alias("threshold"))


