"""Sources and sinks (S01-S15), serving (Q01-Q08), verdicts (X01-X08), feature-variant plug-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import clip
from tidegauge.operators import align
from tidegauge.operators import backtest as K
from tidegauge.operators import ensemble as E
from tidegauge.operators import experiments as X
from tidegauge.operators import features as FX
from tidegauge.operators import metrics as V
from tidegauge.operators import serving as Q
from tidegauge.plans import oracle_base as B
from tidegauge.plans.backtest_queries import event_rows, replay
from tidegauge.plans.calibration_queries import member_bands
from tidegauge.plans.composite_queries import labelled
from tidegauge.plans.metric_queries import metrics_sql, r6, sweep, table
from tidegauge.plans.registry import query
from tidegauge.session import new_table_path
from tidegauge.sources import catalog
from tidegauge.sources import observations as S
from tidegauge.sources import stores

ESI = ["entity_id", "series_id"]


# ---- sources ------------------------------------------------------------------------


@query("s01_series_catalogue", sql="""SELECT s.series_id, category, description, lag_months, countercyclical, scale, COUNT(value) AS n_values FROM series_catalog s LEFT JOIN macro m ON m.series_id = s.series_id GROUP BY ALL""")
def s01(t):
    cat = catalog.series_catalog(t.spark).select("series_id", "category", "description", "lag_months", "countercyclical", "scale")
    counts = t.macro.groupBy("series_id").agg(F.count("value").alias("n"))
    return cat.join(counts, "series_id", "left").select(*cat.columns, F.coalesce("n", F.lit(0)).alias("n_values"))


B.add("raw_obs", "SELECT entity_id, CASE WHEN series_id = 'revenue' THEN 'PAYEMS' WHEN series_id = 'orders' THEN 'HOUST' ELSE 'NOTLISTED' END AS series_id, obs_date, value FROM obs_daily")


def raw_obs(t):
    name = F.when(F.col("series_id") == "revenue", "PAYEMS").when(F.col("series_id") == "orders", "HOUST").otherwise("NOTLISTED")
    return t.obs_daily.withColumn("series_id", name)


@query("s02_load_observations", sql="""SELECT entity_id, s.series_id, obs_date, ROUND(value, 6) AS value FROM raw_obs r JOIN series_catalog s ON r.series_id = s.source_id
WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'""")
def s02(t):
    return S.load(raw_obs(t), catalog.series_catalog(t.spark), "1996-01-01", "2000-06-30").withColumn("value", F.round("value", 6))


@query("s03_required_series", sql="SELECT COUNT(value) AS n_values FROM monthly WHERE series_id = 'revenue'")
def s03(t):
    return S.require_series(t.monthly, "revenue")


@query("s04_parse_payload", sql="SELECT entity_id, series_id, period_end AS obs_date, CASE WHEN MONTH(period_end) % 4 <> 0 THEN ROUND(value, 6) END AS value FROM monthly WHERE YEAR(period_end) <> 1997")
def s04(t):
    date = F.when(F.year("period_end") == 1997, "bad").otherwise(F.col("period_end").cast("string"))
    value = F.when(F.month("period_end") % 4 == 0, ".").otherwise(F.col("value").cast("string"))
    packed = t.monthly.groupBy(*ESI).agg(F.to_json(F.struct(F.collect_list(F.struct(date.alias("date"), value.alias("value"))).alias("observations"))).alias("payload"))
    return S.parse_payload(packed).withColumn("value", F.round("value", 6))


@query("s05_vintage_store", sql="SELECT entity_id, series_id, obs_date, realtime_start, realtime_end, ROUND(value, 6) AS value FROM vintages")
def s05(t):
    path = new_table_path(t.spark, "obs_vintage")
    stores.append(t.vintages, path, ["series_id"])
    stores.append(t.vintages.where("realtime_start <= date '1998-12-31'"), path, ["series_id"])
    return stores.read_vintages(t.spark, path).withColumn("value", F.round("value", 6))


def requests(t):
    dates = t.origins.select(F.col("origin").alias("asof"))
    names = F.explode(F.array(F.lit("revenue"), F.lit("orders"))).alias("series_id")
    return dates.select("asof", names).unionByName(dates.select(F.add_months("asof", -120).alias("asof"), names))


_REQ = '(SELECT origin AS "asof" FROM origins UNION ALL SELECT CAST(origin - INTERVAL 120 MONTH AS DATE) FROM origins)'


@query("s06_negative_cache", sql=f"""WITH f AS (SELECT MIN(realtime_start) AS f0 FROM vintages), r AS (SELECT "asof", s.series_id FROM {_REQ}, (VALUES ('revenue'), ('orders')) AS s(series_id))
SELECT series_id, "asof", 'refetch' AS mode FROM r, f WHERE NOT (series_id = 'revenue' AND f0 <= "asof")""")
def s06(t):
    wanted = requests(t)
    covered = stores.coverage(t.vintages, wanted)
    everything = stores.still_to_load(wanted, covered).withColumn("mode", F.lit("first"))
    return everything.unionByName(stores.still_to_load(wanted, covered, refetch_empty=True).withColumn("mode", F.lit("refetch")))


@query("s07_freshness", sql="""SELECT entity_id, series_id, MAX(period_end) AS latest, date_diff('day', MAX(period_end), DATE '2002-02-20') AS days_old, date_diff('day', MAX(period_end), DATE '2002-02-20') > 180 AS stale FROM monthly GROUP BY 1, 2""")
def s07(t):
    df = S.freshness(t.monthly, ESI, "2002-02-20", 180)
    return df.withColumn("days_old", F.col("days_old").cast("bigint"))


def run_scores(t):
    return t.score_panel.select(F.date_format("period_end", "yyyy").alias("run_id"), "entity_id", "period_end", F.lit(6).alias("horizon"), "model", "prob")


@query("s08_predictions_store", sql="SELECT strftime(period_end, '%Y') AS run_id, entity_id, period_end, 6 AS horizon, model, ROUND(prob, 6) AS prob FROM score_panel WHERE YEAR(period_end) = 1999")
def s08(t):
    path = stores.write_scores(run_scores(t), new_table_path(t.spark, "scores"))
    return stores.read_scores(t.spark, path, "1999").withColumn("prob", F.round("prob", 6))


@query("s09_indicators_store", sql="SELECT entity_id, period_end, ROUND(EBP_PROXY, 6) AS EBP_PROXY, ROUND(SAHM_INDICATOR, 6) AS SAHM_INDICATOR FROM blocks")
def s09(t):
    path = stores.append(FX.wide_features(t.macro), new_table_path(t.spark, "features_wide"))
    return t.spark.read.parquet(path).select("entity_id", "period_end", *[F.round(c, 6).alias(c) for c in ("EBP_PROXY", "SAHM_INDICATOR")])


@query("s10_component_store", sql="SELECT composite, component, COUNT(*) AS n_rows, COUNT(z) AS n_scores FROM component_z GROUP BY 1, 2")
def s10(t):
    from tidegauge.plans.composite_queries import parts

    path = stores.append(parts(t), new_table_path(t.spark, "composite_components"), ["composite"])
    return t.spark.read.parquet(path).groupBy("composite", "component").agg(F.count(F.lit(1)).alias("n_rows"), F.count("z").alias("n_scores"))


@query("s11_result_tables", sql="SELECT run_id, model, threshold, tp, fp, ROUND(f1, 6) AS f1 FROM sweep WHERE run_id = '1996'")
def s11(t):
    path = stores.append(sweep(t), new_table_path(t.spark, "threshold_sweep"), ["run_id"])
    kept = t.spark.read.schema("model STRING, threshold DOUBLE, tp BIGINT, fp BIGINT, f1 DOUBLE, run_id STRING").parquet(path).where("run_id = '1996'")
    return kept.select("run_id", "model", "threshold", "tp", "fp", F.round("f1", 6).alias("f1"))


B.add("run_rows", "SELECT strftime(period_end, '%Y') AS run_id, period_end, y, model, prob FROM score_panel")
B.add("run_metrics", metrics_sql("run_rows", "run_id, model"))


@query("s12_run_manifest", sql="""SELECT run_id, COUNT(*) AS n_rows, MAX(period_end) AS latest_prediction, MAX(period_end) FILTER (y IS NOT NULL) AS latest_known, COUNT(DISTINCT model) AS n_models,
 ROUND(MAX(m.auc), 6) AS auc, ROUND(MAX(m.brier), 6) AS brier FROM run_rows LEFT JOIN (SELECT run_id, auc, brier FROM run_metrics WHERE model = 'ensemble') m USING (run_id) GROUP BY 1""")
def s12(t):
    runs = t.score_panel.withColumn("run_id", F.date_format("period_end", "yyyy"))
    headline = V.metrics_table(runs, ["run_id", "model"]).where("model = 'ensemble'").select("run_id", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))
    return stores.run_manifest(runs, headline)


@query("s13_incumbent", sql="""WITH r AS (SELECT entity_id, strftime(period_end, '%Y-%m') AS run_id, CASE WHEN flag = 1 THEN NULL ELSE 'conservative_40' END AS candidate_id,
 CASE WHEN MONTH(period_end) % 2 = 0 THEN 'many' ELSE CAST(30 + MONTH(period_end) AS VARCHAR) END AS max_features, CASE WHEN flag = 1 THEN '?' ELSE '7' END AS n_cv_splits FROM regime)
SELECT entity_id, run_id, COALESCE(candidate_id, 'baseline_50') AS candidate_id, COALESCE(TRY_CAST(max_features AS INT), 50) AS max_features, COALESCE(TRY_CAST(n_cv_splits AS INT), 5) AS n_cv_splits
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY run_id DESC) AS k FROM r) WHERE k = 1""")
def s13(t):
    month = F.month("period_end")
    runs = t.regime.select(
        "entity_id", F.date_format("period_end", "yyyy-MM").alias("run_id"), F.when(F.col("flag") == 1, None).otherwise("conservative_40").alias("candidate_id"),
        F.when(month % 2 == 0, "many").otherwise((month + 30).cast("string")).alias("max_features"), F.when(F.col("flag") == 1, "?").otherwise("7").alias("n_cv_splits"))
    return stores.incumbent(runs, ["entity_id"])


@query("s14_quality_gate", sql="""SELECT entity_id, COUNT(DISTINCT series_id) AS n_series, COUNT(*) FILTER (series_id = 'coincident_PAYEMS') AS n_label, COUNT(DISTINCT period_end) AS n_periods,
 'leading_NONE' AS missing_anchors, FALSE AS passed FROM macro WHERE value IS NOT NULL GROUP BY 1""")
def s14(t):
    return S.quality_gate(t.macro, ["leading_T10Y3M", "monetary_DFF", "leading_NONE"], "coincident_PAYEMS", min_label=60, min_rows=60, strict=False)


@query("s15_missing_profile", sql="SELECT series_id, ROUND(1 - COUNT(value) / COUNT(*), 6) AS missing_share FROM macro GROUP BY 1 ORDER BY ROUND(1 - COUNT(value) / COUNT(*), 9) DESC, series_id LIMIT 10")
def s15(t):
    return S.missing_profile(t.macro).withColumn("missing_share", F.round("missing_share", 6))


# ---- serving ----------------------------------------------------------------------------


@query("q01_latest_score", sql="""WITH r AS (SELECT *, CASE WHEN CAST(entity_id AS INT) % 2 = 0 THEN 12 ELSE 18 END AS horizon FROM final_band WHERE period_end BETWEEN DATE '1999-01-31' AND DATE '2000-12-31')
SELECT entity_id, horizon, COUNT(*) AS n_rows, MAX(period_end) AS period_end, ROUND(arg_max(prob, period_end), 6) AS prob, ROUND(arg_max(ci_lower, period_end), 6) AS ci_lower, ROUND(arg_max(ci_upper, period_end), 6) AS ci_upper,
 CASE WHEN arg_max(prob, period_end) < 0.15 THEN 'LOW' WHEN arg_max(prob, period_end) < 0.35 THEN 'MODERATE' WHEN arg_max(prob, period_end) < 0.6 THEN 'ELEVATED' ELSE 'HIGH' END AS band FROM r GROUP BY 1, 2""")
def q01(t):
    horizon = F.when(F.col("entity_id").cast("int") % 2 == 0, 12).otherwise(18)
    df = Q.latest_score(member_bands(t).withColumn("horizon", horizon), ["entity_id"], "1999-01-31", "2000-12-31", 12)
    return df.select("entity_id", "horizon", "n_rows", "period_end", *r6(df, "prob", "ci_lower", "ci_upper"), "band")


@query("q02_peer_comparison", sql="""SELECT m.entity_id, series_id, ROUND(arg_max(value * scale, period_end) FILTER (value IS NOT NULL), 6) AS peer, ROUND(MAX(own), 6) AS own,
 ROUND(MAX(own) - arg_max(value * scale, period_end) FILTER (value IS NOT NULL), 6) AS difference FROM macro m JOIN series_catalog USING (series_id)
 JOIN (SELECT entity_id, arg_max(prob, period_end) AS own FROM score_panel WHERE model = 'ensemble' GROUP BY 1) o ON o.entity_id = m.entity_id WHERE category = 'reference' GROUP BY 1, 2""")
def q02(t):
    peers = catalog.series_catalog(t.spark).where("category = 'reference'").select("series_id", "scale")
    scaled = t.macro.join(peers, "series_id").withColumn("value", F.col("value") * F.col("scale"))
    df = Q.peer_comparison(t.score_panel.where("model = 'ensemble'"), scaled, ["entity_id"])
    return df.select(*ESI, *r6(df, "peer", "own", "difference"))


@query("q03_indicator_summary", sql="""SELECT entity_id, series_id, ROUND(MAX(value) FILTER (r = 1), 6) AS current, MAX(period_end) FILTER (r = 1) AS as_of, ROUND(MAX(value) FILTER (r = 1) - MAX(value) FILTER (r = 12), 6) AS change_11,
 ROUND(100 * (MAX(value) FILTER (r = 1) - MAX(value) FILTER (r = 12)) / NULLIF(ABS(MAX(value) FILTER (r = 12)), 0), 6) AS change_11_pct FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, series_id ORDER BY period_end DESC) AS r FROM macro WHERE value IS NOT NULL) GROUP BY 1, 2""")
def q03(t):
    df = Q.indicator_summary(t.macro)
    return df.select(*ESI, F.round("current", 6).alias("current"), "as_of", *r6(df, "change_11", "change_11_pct"))


@query("q04_trend_slice", sql="""SELECT entity_id, series_id, period_end, ROUND(value, 6) AS value FROM (SELECT *, COUNT(*) OVER (PARTITION BY entity_id, series_id) AS n FROM panel WHERE value IS NOT NULL AND period_end >= DATE '1996-07-31') WHERE n > 1""")
def q04(t):
    return Q.trend_slice(t.panel, "2001-07-31").withColumn("value", F.round("value", 6))


@query("q05_indicator_statistics", sql="""SELECT entity_id, series_id, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, ROUND(MIN(value) FILTER (r <= 12), 6) AS recent_low, ROUND(MAX(value) FILTER (r <= 12), 6) AS recent_high FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, series_id ORDER BY period_end DESC) AS r FROM panel) GROUP BY 1, 2""")
def q05(t):
    df = Q.indicator_statistics(t.panel)
    values = F.transform("recent", lambda x: x["value"])
    return df.select(*ESI, *r6(df, "mean", "std"), F.round(F.array_min(values), 6).alias("recent_low"), F.round(F.array_max(values), 6).alias("recent_high"))


@query("q06_top_thresholds", longs=("rank",), sql="""SELECT run_id, model, threshold, rank, threshold = chosen_t AS chosen FROM (SELECT s.*, c.threshold AS chosen_t, ROW_NUMBER() OVER (PARTITION BY s.run_id, s.model
 ORDER BY ROUND(s.f1, 9) DESC, ROUND(s.precision, 9) DESC, ROUND(s.specificity, 9) DESC, s.threshold) AS rank FROM sweep s JOIN chosen c ON s.run_id = c.run_id AND s.model = c.model) WHERE rank <= 10""")
def q06(t):
    s, keys = sweep(t), ["run_id", "model"]
    chosen = E.choose_threshold(s, keys).select(*keys, F.col("threshold").alias("_c"))
    return Q.top_thresholds(s, keys).join(chosen, keys).select(*keys, "threshold", "rank", (F.round("threshold", 2) == F.round("_c", 2)).alias("chosen"))


@query("q07_event_spans", sql="SELECT entity_id, start_month AS span_start, last_day(end_month + INTERVAL 1 MONTH) AS span_end FROM windows")
def q07(t):
    return Q.event_spans(t.regime)


@query("q08_derived_series", sql="SELECT entity_id, feature, period_end, ROUND(value, 6) AS value FROM features_long WHERE starts_with(feature, 'leading_T10Y3M')")
def q08(t):
    return Q.with_derived(FX.engineer(t.macro), "leading_T10Y3M").select("entity_id", "feature", "period_end", F.round("value", 6).alias("value"))


# ---- experiments ---------------------------------------------------------------------------


def ablation_frame(t):
    """Labelled real-time features with a chronological split per entity."""
    frame = K.model_frame(t.panel.withColumn("_k", F.lit(1)), ["_k"]).drop("_k").join(t.score_wide.select("entity_id", "period_end", "y"), ["entity_id", "period_end"]).where("y is not null")
    w = Window.partitionBy("entity_id")
    share = F.row_number().over(w.orderBy("period_end")) / F.count(F.lit(1)).over(w)
    return frame.withColumn("is_train", share <= 0.8)


@query("x01_variant_bake_off")
def x01(t):
    """One result row per feature variant; all variants are fitted in the same jobs."""
    masks = {"hybrid": K.MODEL_FEATURES, "continuous_only": K.MODEL_FEATURES[:3], "at_risk_only": K.MODEL_FEATURES[3:]}
    wide = ablation_frame(t).select("*", F.explode(F.array(*[F.lit(v) for v in masks])).alias("variant"))
    kept = {f: F.when(F.col("variant").isin([v for v, fs in masks.items() if f in fs]), F.col(f)).otherwise(0.0) for f in K.MODEL_FEATURES}
    rows = wide.withColumns(kept)
    train = F.col("is_train")
    scaled = K.keyed_logit.standardise(rows, ["variant"], K.MODEL_FEATURES, train)
    coef = K.keyed_logit.fit(scaled.where(train), ["variant"], K.MODEL_FEATURES)
    scored = K.keyed_logit.score(scaled.where(~train), coef, ["variant"], K.MODEL_FEATURES)
    return V.metrics_table(scored, ["variant"], 0.3).select("variant", "auc", "pr_auc", "brier", "f1")


B.add("bake", """SELECT c.run_id, c.model AS variant, c.pr_auc AS cv_pr_auc, i.pr_auc AS test_pr_auc, c.n_tp AS detected FROM score_metrics c JOIN score_metrics i ON c.model = i.model AND i.run_id = '1998'""")


@query("x02_bake_off_verdict", sql="""WITH s AS (SELECT *, ROUND(COALESCE(cv_pr_auc, test_pr_auc), 9) AS s FROM bake), w AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY COALESCE(s, -1) DESC, CAST(variant = 'm3' AS INT) DESC, variant DESC) AS r FROM s) WHERE r = 1),
j AS (SELECT w.run_id, w.variant AS winner, CASE WHEN w.variant = 'm3' THEN 0 ELSE w.s - h.s END AS margin, w.detected >= h.detected AS parity, h.test_pr_auc - w.test_pr_auc AS regression FROM w JOIN s h ON h.run_id = w.run_id AND h.variant = 'm3')
SELECT run_id, winner, ROUND(margin, 6) AS margin, CASE WHEN winner = 'm3' THEN 'DISCARD' WHEN margin >= 0.01 AND parity AND regression <= 0.01 THEN 'KEEP' WHEN margin >= 0.01 THEN 'NEEDS-WORK' ELSE 'DISCARD' END AS verdict FROM j""")
def x02(t):
    m = table(t)
    test = m.where("run_id = '1998'").select("model", F.col("pr_auc").alias("test_pr_auc"))
    results = m.select("run_id", "model", F.col("pr_auc").alias("cv_pr_auc"), F.col("n_tp").alias("detected")).join(test, "model").withColumnRenamed("model", "variant")
    return X.bake_off(results, ["run_id"], champion="m3").withColumn("margin", F.round("margin", 6))


@query("x03_drop_one_ablation")
def x03(t):
    scored = X.ablation(ablation_frame(t), [], K.MODEL_FEATURES, F.col("is_train"))
    m = V.metrics_table(scored, ["ablated"], 0.3).withColumn("_k", F.lit("all"))
    base = m.where("ablated = 'none'").select("_k", *[F.col(c).alias(f"_{c}") for c in ("auc", "pr_auc", "brier")])
    return m.where("ablated <> 'none'").join(base, "_k").select("ablated", *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in ("auc", "pr_auc", "brier")])


B.add("bundle", """SELECT entity_id, MAX(peak_prob) FILTER (model = 'm1') AS b_peak, AVG(auc) FILTER (model = 'm1') AS b_auc, MAX(peak_prob) FILTER (model = 'ensemble') AS peak, AVG(auc) FILTER (model = 'ensemble') AS mean_auc,
 COUNT(*) FILTER (model = 'ensemble' AND crossed) AS detected, AVG(brier) FILTER (model = 'm1') - AVG(brier) FILTER (model = 'ensemble') AS loo_brier_delta, COUNT(*) FILTER (model = 'ensemble' AND crossed) / 50.0 AS weight FROM event_rows GROUP BY 1""")


@query("x04_member_addition", sql="""SELECT entity_id, ROUND(peak - b_peak, 6) AS peak_delta, ROUND(mean_auc - b_auc, 6) AS auc_delta, CASE WHEN COALESCE(peak - b_peak >= 0.03 OR (weight >= 0.05 AND loo_brier_delta > 0) OR (mean_auc - b_auc >= 0.01 AND detected >= 4), FALSE) THEN 'KEEP'
 WHEN weight <= 0 AND COALESCE(ABS(peak - b_peak), 0) < 0.01 THEN 'DISCARD' ELSE 'NEEDS-WORK' END AS verdict FROM bundle""")
def x04(t):
    rows = event_rows(t)
    side = lambda m: F.col("model") == m
    when = lambda m, c: F.when(side(m), F.col(c))
    n = F.count_if(side("ensemble") & F.col("crossed"))
    per = rows.groupBy("entity_id").agg(
        F.max(when("m1", "peak_prob")).alias("b_peak"), F.avg(when("m1", "auc")).alias("b_auc"), F.max(when("ensemble", "peak_prob")).alias("peak"),
        F.avg(when("ensemble", "auc")).alias("mean_auc"), n.alias("detected"), (F.avg(when("m1", "brier")) - F.avg(when("ensemble", "brier"))).alias("loo_brier_delta"), (n / 50.0).alias("weight"))
    before = per.select("entity_id", F.col("b_peak").alias("peak"), F.col("b_auc").alias("mean_auc"))
    df = X.member_addition(before, per.drop("b_peak", "b_auc"), ["entity_id"])
    return df.select("entity_id", *r6(df, "peak_delta", "auc_delta"), "verdict")


@query("x05_replay_verdict", sql="""WITH f AS (SELECT entity_id, COUNT(*) FILTER (signal_vintage <> signal_simulated) AS n_flips FROM replay WHERE category = 'event' GROUP BY 1)
SELECT entity_id, n_flips, CASE WHEN mean_abs_gap < 0.015 THEN 'keep_simulation' WHEN mean_abs_gap > 0.03 OR max_abs_gap > 0.10 THEN 'switch_to_vintage_for_strict_search' ELSE 'mixed' END AS recommendation,
 CASE WHEN mean_abs_gap > 0.03 OR max_abs_gap > 0.10 OR n_flips > 0 THEN 'KEEP' WHEN mean_abs_gap < 0.015 THEN 'DISCARD' ELSE 'NEEDS-WORK' END AS verdict FROM replay_stats JOIN f USING (entity_id)""")
def x05(t):
    rows = replay(t)
    flips = rows.where("category = 'event'").groupBy("entity_id").agg(F.count_if(F.col("signal_vintage") != F.col("signal_simulated")).alias("n_flips"))
    stats = K.replay_statistics(rows, ["entity_id"]).join(flips, "entity_id")
    return K.replay_verdict(stats).select("entity_id", "n_flips", "recommendation", "verdict")


B.add("upgrade", """SELECT s.run_id, s.model, 100 * (s.pr_auc - b.pr_auc) / b.pr_auc AS d_pr_auc_pct, 0.4 + s.auc AS mean_auc, e.ece AS best_ece, e.ece * 1.2 AS raw_ece, 0.2 AS reference_ece, s.recall AS coverage, CAST(s.n_tp / 100 AS BIGINT) AS detected, s.precision AS key_peak
 FROM score_metrics s JOIN score_metrics b ON b.run_id = s.run_id AND b.model = 'm1' JOIN score_ece e ON e.run_id = s.run_id AND e.model = s.model""")
_G = {"pr_auc_within_5pct": "d_pr_auc_pct >= -5", "auc_ge_0_90": "mean_auc >= 0.9", "ece_le_0_10": "best_ece <= 0.1", "ece_not_regressed": "best_ece <= reference_ece * 1.1", "raw_ece_le_0_10": "raw_ece <= 0.1",
      "coverage_ge_85pct": "coverage >= 0.85", "five_detected": "detected >= 5", "key_peak_ge_0_33": "key_peak >= 0.33"}


@query("x06_upgrade_gates", sql=f"""SELECT run_id, model, {', '.join(f'{e} AS {n}' for n, e in _G.items())}, CASE WHEN d_pr_auc_pct <= -15 OR best_ece > reference_ece * 1.5 OR detected = 0 THEN 'DISCARD'
 WHEN (best_ece <= 0.1 OR best_ece <= reference_ece * 1.1) AND coverage >= 0.85 AND detected >= 5 AND mean_auc >= 0.9 THEN 'KEEP' ELSE 'NEEDS-WORK' END AS verdict FROM upgrade""")
def x06(t):
    from tidegauge.operators import calibration as C

    m = table(t)
    base = m.where("model = 'm1'").select("run_id", F.col("pr_auc").alias("_b"))
    rows = m.join(base, "run_id").join(C.calibration_error(t.scores, ["run_id", "model"]), ["run_id", "model"])
    bundle = rows.select(
        "run_id", "model", (100 * (F.col("pr_auc") - F.col("_b")) / F.col("_b")).alias("d_pr_auc_pct"), (0.4 + F.col("auc")).alias("mean_auc"), F.col("ece").alias("best_ece"),
        (F.col("ece") * 1.2).alias("raw_ece"), F.lit(0.2).alias("reference_ece"), F.col("recall").alias("coverage"), F.round(F.col("n_tp") / 100).cast("bigint").alias("detected"), F.col("precision").alias("key_peak"))
    return X.upgrade_gates(bundle).select("run_id", "model", *X.GATES, "verdict")


@query("x07_frozen_rescore", sql=f"""SELECT entity_id, ROUND(auc, 6) AS auc, ROUND(brier, 6) AS brier, n_tp, n_fp FROM ({metrics_sql("(SELECT entity_id, y, 0.5 * m1 + 0.3 * m2 + 0.2 * m3 AS prob FROM labelled_n WHERE rn > n - 50)", "entity_id", "0.45")})""")
def x07(t):
    scored = X.frozen_rescore(labelled(t), {"m1": 0.5, "m2": 0.3, "m3": 0.2}, ["entity_id"], last=50)
    df = V.metrics_table(scored, ["entity_id"], 0.45)
    return df.select("entity_id", *r6(df, "auc", "brier"), "n_tp", "n_fp")


@query("x08_origin_scope", sql="SELECT scope, COUNT(*) AS n_rows, CAST(SUM(signal_vintage) AS BIGINT) AS n_signals FROM replay r JOIN origins o ON r.origin = o.origin GROUP BY 1")
def x08(t):
    rows = replay(t).join(t.origins.select("origin", "scope"), "origin")
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("signal_vintage").cast("bigint").alias("n_signals"))


@query("r04_own_variant", sql="SELECT feature, COUNT(value) AS n_values FROM features_long WHERE starts_with(feature, 'financial_') AND NOT ends_with(feature, '_AT_RISK') GROUP BY 1")
def r04(t):
    own = FX.layer() != "at_risk"
    kept = FX.engineer(t.macro).where(own & F.col("feature").startswith("financial_"))
    return kept.groupBy("feature").agg(F.count("value").alias("n_values"))


__all__ = ["align", "clip"]
