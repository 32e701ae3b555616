"""Backtests (B01-B18), stability gate (T01-T06), backtest summaries."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import shift_months
from tidegauge.operators import align
from tidegauge.operators import backtest as K
from tidegauge.operators import features as FX
from tidegauge.operators import metrics as V
from tidegauge.operators import prefix_fits as PF
from tidegauge.plans import oracle_base as B
from tidegauge.plans.align_queries import masked, realtime_panel
from tidegauge.plans.feature_queries import STANDARD
from tidegauge.plans.metric_queries import metrics_sql, r6
from tidegauge.plans.registry import query
from tidegauge.session import durable
from tidegauge.sources import catalog

FIXED = 0.45
MEE = ["model", "entity_id", "event"]

_STD = {k: v.replace("PARTITION BY entity_id", "PARTITION BY origin, entity_id") for k, v in STANDARD.items()}
B.add("realtime_standard", f"""SELECT origin, entity_id, concat(series_id, suffix) AS feature, period_end, value FROM (
 SELECT origin, entity_id, series_id, period_end, {', '.join(f'{e} AS "{s}"' for s, e in _STD.items())} FROM masked)
 UNPIVOT INCLUDE NULLS (value FOR suffix IN ({', '.join(f'"{s}"' for s in _STD)}))""")
REALTIME = "SELECT origin, entity_id, feature, period_end, ROUND(value, 6) AS value FROM realtime_standard"


@query("b01_realtime_features", sql=REALTIME)
def b01(t):
    return K.realtime_features(t.panel, t.origins, t.lags5).withColumn("value", F.round("value", 6))


@query("b01_realtime_features_shared", sql=REALTIME)
def b01_shared(t):
    return K.realtime_features_shared(t.panel, t.origins, t.lags5).withColumn("value", F.round("value", 6))


@query("b02_strict_frames", sql="""SELECT origin, entity_id, series_id, period_end, role, ROUND(value, 6) AS value, y FROM (SELECT *, CASE WHEN period_end <= last_day(origin - INTERVAL 6 MONTH) AND y IS NOT NULL THEN 'train'
 WHEN period_end = origin THEN 'predict' END AS role FROM origin_frame) WHERE role IS NOT NULL""")
def b02(t):
    from tidegauge.plans.composite_queries import origin_frame

    return K.strict_frames(origin_frame(t), 6).select("origin", "entity_id", "series_id", "period_end", "role", F.round("value", 6).alias("value"), "y")


HORIZON = 6
#: Panel series whose high values are the weak ones.
COUNTERCYCLICAL = ["failed_share", "urgent_share"]


def whole_frame(panel, keys=()):
    """Every feature of every series: values, standard transforms, at-risk flags."""
    return FX.long_features(panel, COUNTERCYCLICAL, minimum=12, keys=keys)


class Replay:
    """Training sums, fits, thresholds and rows to predict of the backtests, over the whole feature frame.

    Two training sets per origin: ``shared`` (features look back and the mask touches fewer months than the horizon, so revised and
    lag-masked data train alike: running sums over months), and ``vintage`` (sums per origin over its own frame).
    """

    def __init__(self, t, scenarios, candidates, horizon=HORIZON):
        self.t, self.horizon, self.candidates = t, horizon, candidates
        longest = max(1, t.lags5.agg(F.max("lag_months")).first()[0] or 0)
        self.sets = {"revised": "shared", "simulated": "shared" if longest <= horizon else "simulated", "vintage": "vintage"}
        self.scenarios = scenarios
        base = whole_frame(t.panel)
        self.names = [r[0] for r in base.select("feature").distinct().orderBy("feature").collect()]  # series times transforms
        self.scale = durable(PF.scale_of(base))
        self.labels = t.score_wide.select("entity_id", "period_end", "y")
        self.base = durable(self._labelled(PF.vectors(base, self.names, self.scale)))
        self.first = self.base.agg(F.min("period_end")).first()[0]

    def _labelled(self, rows):
        return rows.join(self.labels, ["entity_id", "period_end"], "left")

    @cached_property
    def monthly(self):
        return durable(PF.sums(self.base, ["period_end"], len(self.names)))

    def frame(self, scenario):
        """(origin, entity_id, period_end, x, y) as it looked at each origin."""
        panels = {"revised": lambda: align.as_of(self.t.panel, self.t.origins), "simulated": lambda: masked(self.t), "vintage": lambda: realtime_panel(self.t)}
        panel = panels[scenario]().select("origin", "entity_id", "series_id", "period_end", "value")
        return self._labelled(PF.vectors(whole_frame(panel, ("origin",)), self.names, self.scale, ["origin"]))

    @cached_property
    def frames(self):
        return {s: durable(self.frame(s)) for s in self.scenarios if s != "revised"}

    def known(self, rows):
        return rows.where((F.col("period_end") <= shift_months("origin", -self.horizon)) & F.col("y").isNotNull())

    def cells(self, chosen):
        if chosen == "shared":
            cuts = self.t.origins.select("origin", shift_months("origin", -self.horizon).alias("cut"))
            return PF.up_to(self.monthly, cuts, len(self.names)).join(cuts, "cut").select("origin", "i", "v")
        return PF.sums(self.known(self.frames[chosen]), ["origin"], len(self.names))

    @cached_property
    def fitted(self):
        used = sorted({self.sets[s] for s in self.scenarios})
        cells = reduce(DataFrame.unionByName, [self.cells(u).withColumn("training", F.lit(u)) for u in used])
        return durable(PF.fits(cells, ["training", "origin"], self.candidates, len(self.names)))

    @cached_property
    def thresholds(self):
        parts = []
        for used in sorted({self.sets[s] for s in self.scenarios}):
            if used == "shared":
                months = PF.training_months(self.t.origins.withColumn("first", F.lit(self.first)), "first", self.horizon)
                rows = self.base.where("y is not null").join(months, "period_end")
            else:
                rows = self.known(self.frames[used])
            parts.append(rows.select("origin", "entity_id", "period_end", "x", "y").withColumn("training", F.lit(used)))
        scored = PF.scores(reduce(DataFrame.unionByName, parts), self.fitted.where("reason is null"), ["training", "origin"])
        return durable(PF.own_thresholds(scored, ["training", "origin", "candidate_id"]))

    def results(self):
        """(scenario, origin, entity_id, candidate_id, ...) of every origin row."""
        now = F.col("period_end") == F.col("origin")
        parts = []
        for s in self.scenarios:
            rows = self.frames[s].where(now) if s != "revised" else self.base.join(self.t.origins.select("origin"), now)
            parts.append(rows.select(F.lit(s).alias("scenario"), F.lit(self.sets[s]).alias("training"), "origin", "entity_id", "period_end", "x", "y"))
        keys = ["training", "origin"]
        out = PF.backtest(reduce(DataFrame.unionByName, parts), self.fitted, self.thresholds, keys, ["scenario"])
        return out.drop("training")


def candidates_of(*names):
    """The curated candidates: how many features each keeps, and its penalty 1 / C."""
    return [(c[0], c[2], 1.0 / float(c[4].get("logit.C", "0.1"))) for c in catalog.CANDIDATES if not names or c[0] in names]


@query("b03_strict_backtest")
def b03(t):
    return Replay(t, ["simulated"], candidates_of("baseline_50")).results()


def candidate_rows(t):
    """Origin results of four candidates, taken from the members' scores at the origins."""
    at = t.score_panel.join(t.origins.select("origin"), F.col("period_end") == F.col("origin"))
    return at.select(F.col("model").alias("candidate_id"), "origin", "entity_id", F.col("y").alias("actual"), "prob", F.lit(FIXED).alias("threshold"),
                     (F.col("prob") >= FIXED).cast("int").alias("signal"), F.months_between("origin", F.lit("1995-01-31").cast("date")).cast("int").alias("train_rows"))


B.add("candidate_rows", f"""SELECT model AS candidate_id, origin, entity_id, y AS actual, y, prob, {FIXED} AS threshold, CASE WHEN prob >= {FIXED} THEN 1 ELSE 0 END AS signal,
 date_diff('month', DATE '1995-01-31', origin) AS train_rows FROM score_panel JOIN origins ON period_end = origin WHERE y IS NOT NULL""")
B.add("candidate_metrics", metrics_sql("candidate_rows", "candidate_id", str(FIXED)))
B.add("candidate_summary", """SELECT m.*, origins_tested, positive_origins, signal_rate, mean_threshold, mean_train_rows FROM candidate_metrics m JOIN (
 SELECT candidate_id, COUNT(*) AS origins_tested, CAST(SUM(y) AS BIGINT) AS positive_origins, AVG(signal) AS signal_rate, AVG(threshold) AS mean_threshold, AVG(train_rows) AS mean_train_rows FROM candidate_rows GROUP BY 1) USING (candidate_id)""")
SUMMARY = ["auc", "pr_auc", "brier", "log_loss", "precision", "recall", "f1", "specificity", "signal_rate", "mean_threshold", "mean_train_rows"]


@query("b04_origin_summary", sql=f"SELECT candidate_id, origins_tested, positive_origins, {', '.join(f'ROUND({c}, 6) AS {c}' for c in SUMMARY)} FROM candidate_summary")
def b04(t):
    df = K.origin_summary(candidate_rows(t), ["candidate_id"])
    return df.select("candidate_id", "origins_tested", "positive_origins", *r6(df, *SUMMARY))


@query("b05_candidate_ranking", longs=("rank",), sql="""SELECT candidate_id, ROW_NUMBER() OVER (ORDER BY ROUND(pr_auc, 9) DESC NULLS LAST, ROUND(brier, 9), ROUND(f1, 9) DESC NULLS LAST, ROUND(auc, 9) DESC NULLS LAST, ROUND(precision, 9) DESC NULLS LAST, candidate_id) AS rank FROM candidate_summary""")
def b05(t):
    return K.rank_candidates(K.origin_summary(candidate_rows(t), ["candidate_id"])).select("candidate_id", "rank")


@query("b06_candidate_search")
def b06(t):
    """Every curated candidate on every origin from the same sums; the best two again on true vintages; final rank."""
    first = durable(Replay(t, ["simulated"], candidates_of()).results())
    ranked = K.rank_candidates(K.origin_summary(first, ["candidate_id"]))
    best = [r[0] for r in ranked.where("rank <= 2").select("candidate_id").collect()]
    audit = Replay(t, ["vintage"], candidates_of(*best)).results()
    both = audit.select("candidate_id", "origin", "entity_id", F.col("prob").alias("v")).join(
        first.select("candidate_id", "origin", "entity_id", "prob"), ["candidate_id", "origin", "entity_id"])
    gap = both.groupBy("candidate_id").agg(F.avg(F.abs(F.col("v") - F.col("prob"))).alias("vintage_mae"))
    final = K.rank_candidates(ranked.drop("rank").join(gap, "candidate_id", "left"))
    return final.select("candidate_id", "rank", "origins_tested", "auc", "pr_auc", "brier", "vintage_mae")


@query("b07_expanding_backtest")
def b07(t):
    """For every event, a fit on what was known at its window's beginning; the window is scored and summarised."""
    spans = durable(windows(t))
    frame = Replay(t, ["revised"], candidates_of("baseline_50"))
    # windows that begin in the same month share a fit
    begins = spans.select(F.col("train_end").alias("origin")).distinct()
    cuts = begins.select("origin", shift_months("origin", -HORIZON).alias("cut"))
    cells = PF.up_to(frame.monthly, cuts, len(frame.names)).join(cuts, "cut").select("origin", "i", "v")
    fitted = durable(PF.fits(cells, ["origin"], frame.candidates, len(frame.names)))
    months = PF.training_months(begins.withColumn("first", F.lit(frame.first)), "first", HORIZON)
    trained = PF.scores(frame.base.where("y is not null").join(months, "period_end"), fitted.where("reason is null"), ["origin"])
    thresholds = PF.own_thresholds(trained, ["origin", "candidate_id"])
    test = frame.base.join(K.window_months(spans).select("entity_id", "event", "period_end", F.col("train_end").alias("origin")), ["entity_id", "period_end"])
    scored = PF.backtest(test, fitted, thresholds, ["origin"], ["event"]).where("prob is not null")
    own = scored.select("candidate_id", "entity_id", "event", "period_end", "prob", "threshold", F.col("actual").alias("y"))
    return K.event_results(own, spans, ["candidate_id"], FIXED)


# ---- event rows over the members' scores ---------------------------------------------

B.add("windows", """SELECT entity_id, strftime(MIN(period_end), '%Y-%m') AS event, last_day(MIN(period_end) - INTERVAL 12 MONTH) AS train_end, MIN(period_end) AS start_month, MAX(period_end) AS end_month
 FROM islands WHERE flag = 1.0 GROUP BY entity_id, island""")
B.add("own_threshold", "SELECT entity_id, model, ROUND(AVG(prob), 2) AS threshold FROM score_panel GROUP BY 1, 2")
B.add("test_rows", """SELECT s.model, s.entity_id, w.event, s.period_end, s.y, s.prob, o.threshold, w.train_end FROM score_panel s JOIN windows w ON s.entity_id = w.entity_id AND s.period_end > w.train_end AND s.period_end <= w.end_month
 JOIN own_threshold o ON o.entity_id = s.entity_id AND o.model = s.model""")
B.add("test_metrics", metrics_sql("test_rows", "model, entity_id, event"))
B.add("event_rows", f"""SELECT r.*, date_diff('day', first_signal, first_event) / 30.44 AS lead_months, date_diff('day', first_signal_fixed, first_event) / 30.44 AS lead_months_fixed, m.auc, m.brier FROM (
 SELECT model, entity_id, event, MAX(train_end) AS train_end, COUNT(*) AS test_months, CAST(SUM(y) AS BIGINT) AS event_months, MAX(prob) AS peak_prob, MAX(threshold) AS threshold,
 BOOL_OR(prob >= threshold) AS crossed, BOOL_OR(prob >= {FIXED}) AS crossed_fixed, MIN(period_end) FILTER (y = 1) AS first_event, MIN(period_end) FILTER (prob >= threshold) AS first_signal,
 MIN(period_end) FILTER (prob >= {FIXED}) AS first_signal_fixed, MIN(period_end) FILTER (prob = top) AS peak_date FROM (SELECT *, MAX(prob) OVER (PARTITION BY model, entity_id, event) AS top FROM test_rows) GROUP BY 1, 2, 3) r
 LEFT JOIN test_metrics m USING (model, entity_id, event)""")


def windows(t):
    return K.event_windows(t.regime)


def scored(t):
    own = t.score_panel.groupBy("entity_id", "model").agg(F.round(F.avg("prob"), 2).alias("threshold"))
    return t.score_panel.join(own, ["entity_id", "model"])


def event_rows(t, trajectory=False):
    return K.event_results(scored(t), windows(t), ["model"], FIXED, trajectory=trajectory)


@query("b08_event_lead", sql="""SELECT model, entity_id, event, train_end, test_months, event_months, ROUND(auc, 6) AS auc, ROUND(brier, 6) AS brier, ROUND(peak_prob, 6) AS peak_prob, peak_date, threshold, crossed, crossed_fixed,
 first_signal, ROUND(lead_months, 6) AS lead_months, ROUND(lead_months_fixed, 6) AS lead_months_fixed FROM event_rows""")
def b08(t):
    df = event_rows(t)
    return df.select(*MEE, "train_end", "test_months", "event_months", *r6(df, "auc", "brier", "peak_prob"), "peak_date", "threshold", "crossed", "crossed_fixed",
                     "first_signal", *r6(df, "lead_months", "lead_months_fixed"))


@query("b09_member_peaks", sql="SELECT model, entity_id, event, ROUND(MAX(prob), 6) AS peak_prob FROM test_rows GROUP BY 1, 2, 3")
def b09(t):
    return K.member_peaks(t.score_panel, windows(t), ["model"]).withColumn("peak_prob", F.round("peak_prob", 6))


@query("b10_trajectories", sql="""SELECT model, entity_id, event, COUNT(*) AS months, MIN(period_end) AS first_month, ROUND(arg_min(prob, period_end), 6) AS first_prob, ROUND(arg_max(prob, period_end), 6) AS last_prob FROM test_rows GROUP BY 1, 2, 3""")
def b10(t):
    tr = F.col("trajectory")
    return event_rows(t, trajectory=True).select(
        *MEE, F.size(tr).cast("bigint").alias("months"), tr[0]["period_end"].alias("first_month"), F.round(tr[0]["prob"], 6).alias("first_prob"),
        F.round(F.element_at(tr, -1)["prob"], 6).alias("last_prob"))


def scenario_results(t, scenarios):
    return Replay(t, list(scenarios), candidates_of("baseline_50")).results()


def scenario_gap(t, other):
    rows = scenario_results(t, ("revised", other))
    at = lambda s: F.max(F.when(F.col("scenario") == s, F.col("prob")))
    wide = rows.groupBy("origin", "entity_id").agg(at("revised").alias("revised_prob"), at(other).alias("other_prob"))
    return wide.withColumn("gap", F.col("revised_prob") - F.col("other_prob"))


@query("b11_simulated_vintage_backtest")
def b11(t):
    return scenario_gap(t, "simulated")


@query("b12_vintage_backtest")
def b12(t):
    return scenario_gap(t, "vintage")


# Replay rows with an exact oracle: members stand in for the three scenarios.
B.add("replay", """SELECT *, prob_vintage - prob_simulated AS gap_vintage_vs_simulated, prob_vintage - prob_revised AS gap_vintage_vs_revised, prob_simulated - prob_revised AS gap_simulated_vs_revised,
 CAST(prob_vintage >= 0.45 AS INT) AS signal_vintage, CAST(prob_simulated >= 0.45 AS INT) AS signal_simulated FROM (
 SELECT entity_id, origin, category, m1 AS prob_vintage, m2 AS prob_simulated, ensemble AS prob_revised FROM score_wide JOIN origins ON period_end = origin WHERE ensemble IS NOT NULL)""")


def replay(t):
    name = F.when(F.col("model") == "m1", "vintage").when(F.col("model") == "m2", "simulated").when(F.col("model") == "ensemble", "revised")
    rows = t.score_panel.join(t.origins, F.col("period_end") == F.col("origin")).withColumn("scenario", name).where("scenario is not null")
    return K.scenario_table(rows, ["entity_id", "origin", "category"], FIXED)


@query("b13_gap_summary", sql="""SELECT entity_id, COUNT(*) AS n, ROUND(AVG(ABS(g)), 6) AS mean_abs, ROUND(AVG(g), 6) AS mean_signed, ROUND(MAX(ABS(g)), 6) AS max_abs FROM (SELECT *, prob_revised - prob_vintage AS g FROM replay) GROUP BY 1""")
def b13(t):
    df = K.gap_summary(replay(t), ["entity_id"], "prob_revised", "prob_vintage")
    return df.select("entity_id", "n", *r6(df, "mean_abs", "mean_signed", "max_abs"))


@query("b14_three_scenario_replay")
def b14(t):
    rows = scenario_results(t, ("revised", "simulated", "vintage")).join(t.origins.select("origin", "category"), "origin")
    return K.scenario_table(rows, ["entity_id", "origin", "category"], FIXED)


STATS = ["mean_abs_gap", "mean_signed_gap", "max_abs_gap", "std_gap", "mean_abs_vs_revised", "mean_abs_simulated_vs_revised"]
B.add("replay_stats", """SELECT entity_id, COUNT(*) AS n_origins, AVG(ABS(g)) AS mean_abs_gap, AVG(g) AS mean_signed_gap, MAX(ABS(g)) AS max_abs_gap, MIN(origin) FILTER (r = 1) AS max_gap_origin, STDDEV_POP(g) AS std_gap,
 AVG(ABS(gap_vintage_vs_revised)) AS mean_abs_vs_revised, AVG(ABS(gap_simulated_vs_revised)) AS mean_abs_simulated_vs_revised FROM (
 SELECT *, gap_vintage_vs_simulated AS g, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY ROUND(ABS(gap_vintage_vs_simulated), 9) DESC, origin) AS r FROM replay) GROUP BY 1""")


@query("b15_replay_statistics", sql=f"SELECT entity_id, n_origins, max_gap_origin, {', '.join(f'ROUND({c}, 6) AS {c}' for c in STATS)} FROM replay_stats")
def b15(t):
    df = K.replay_statistics(replay(t), ["entity_id"])
    return df.select("entity_id", "n_origins", "max_gap_origin", *r6(df, *STATS))


@query("b16_detection_flips", sql="SELECT entity_id, origin, signal_vintage, signal_simulated, signal_vintage <> signal_simulated AS detection_changes FROM replay WHERE category = 'event'")
def b16(t):
    changed = F.col("signal_vintage") != F.col("signal_simulated")
    return replay(t).where("category = 'event'").select("entity_id", "origin", "signal_vintage", "signal_simulated", changed.alias("detection_changes"))


@query("b17_largest_gaps", sql="SELECT entity_id, origin, ROUND(gap_vintage_vs_simulated, 6) AS gap FROM replay ORDER BY ROUND(ABS(gap_vintage_vs_simulated), 9) DESC, entity_id, origin LIMIT 5")
def b17(t):
    gap = F.col("gap_vintage_vs_simulated")
    return replay(t).orderBy(F.round(F.abs(gap), 9).desc(), "entity_id", "origin").limit(5).select("entity_id", "origin", F.round(gap, 6).alias("gap"))


@query("b18_peer_peaks", sql="""SELECT w.entity_id, w.event, series_id, ROUND(MAX(value * scale), 6) AS peak FROM windows w JOIN macro m ON m.entity_id = w.entity_id AND period_end BETWEEN start_month AND end_month
 JOIN series_catalog USING (series_id) WHERE category = 'reference' GROUP BY 1, 2, 3""")
def b18(t):
    peers = catalog.series_catalog(t.spark).where("category = 'reference'").select("series_id", "scale")
    inside = F.col("period_end").between(F.col("start_month"), F.col("end_month"))
    return t.macro.join(peers, "series_id").join(windows(t), "entity_id").where(inside).groupBy("entity_id", "event", "series_id").agg(
        F.round(F.max(F.col("value") * F.col("scale")), 6).alias("peak"))


# ---- summaries ---------------------------------------------------------------------------

SUMS = ["mean_auc", "min_auc", "max_auc", "mean_brier", "mean_peak", "mean_lead_fixed", "mean_lead", "mean_lead_detected"]
_SUM = """COUNT(*) AS events_tested, ROUND(AVG(auc), 6) AS mean_auc, ROUND(MIN(auc), 6) AS min_auc, ROUND(MAX(auc), 6) AS max_auc, ROUND(AVG(brier), 6) AS mean_brier, ROUND(AVG(peak_prob), 6) AS mean_peak,
 COUNT(*) FILTER (crossed) AS detected, ROUND(AVG(lead_months_fixed), 6) AS mean_lead_fixed, ROUND(AVG(lead_months), 6) AS mean_lead, ROUND(COALESCE(AVG(lead_months) FILTER (crossed), 0), 6) AS mean_lead_detected"""


@query("v08_backtest_summary", sql=f"SELECT model, {_SUM} FROM event_rows WHERE auc IS NOT NULL GROUP BY 1")
def v08(t):
    df = K.backtest_summary(event_rows(t), ["model"])
    return df.select("model", "events_tested", "detected", *r6(df, *SUMS))


@query("v09_scope_summaries", sql=f"""SELECT model, scope, {_SUM} FROM (SELECT *, 'full_history' AS scope FROM event_rows UNION ALL SELECT *, 'in_scope' FROM event_rows WHERE event >= '1998-01') WHERE auc IS NOT NULL GROUP BY 1, 2""")
def v09(t):
    df = K.backtest_summary(K.by_scope(event_rows(t), F.col("event") >= "1998-01"), ["model", "scope"])
    return df.select("model", "scope", "events_tested", "detected", *r6(df, *SUMS))


# ---- stability gate ------------------------------------------------------------------------


@query("t01_baseline_threshold", sql="SELECT arg_max(threshold, entity_id) AS threshold FROM own_threshold WHERE model = 'ensemble'")
def t01(t):
    runs = scored(t).groupBy("entity_id", "model").agg(F.max("threshold").alias("threshold"))
    return K.baseline_threshold(runs.select(F.col("entity_id").alias("run_id"), "threshold", (F.col("model") == "ensemble").alias("is_baseline")))


@query("t02_parse_trajectories", sql="SELECT model, entity_id, event, period_end, ROUND(prob, 6) AS prob FROM test_rows")
def t02(t):
    text = event_rows(t, trajectory=True).select(*MEE, F.to_json("trajectory").alias("raw"))
    return K.parse_trajectory(text, "raw").select(*MEE, F.inline("trajectory")).withColumn("prob", F.round("prob", 6))


# A third of the events lost their trajectory, so that the bounds are exercised too.
def stored(t):
    lost = F.substring("event", 6, 2).cast("int") % 3 == 0
    rows = event_rows(t, trajectory=True)
    return rows.withColumns({c: F.when(~lost, F.col(c)) for c in ("trajectory", "actual")})


B.add("rescored", f"""SELECT *, lead_fixed - lead_months AS lead_delta_fixed FROM (SELECT *, CASE WHEN method = 'exact' THEN lead_months_fixed WHEN method LIKE 'bound_at%' THEN lead_months END AS lead_fixed FROM (
 SELECT *, CAST(substr(event, 6, 2) AS INT) % 3 = 0 AS lost, threshold - {FIXED} AS threshold_shift, CASE WHEN peak_prob IS NULL THEN 'unavailable' WHEN CAST(substr(event, 6, 2) AS INT) % 3 <> 0 THEN
 CASE WHEN first_signal_fixed IS NULL THEN 'exact_no_cross' ELSE 'exact' END WHEN peak_prob < {FIXED} THEN 'exact_no_cross' WHEN lead_months IS NULL THEN 'bound_unknown'
 WHEN threshold IS NULL OR threshold >= {FIXED} THEN 'bound_at_or_earlier' ELSE 'bound_at_or_later' END AS method FROM event_rows))""")


@query("t03_fixed_rescore", sql="""SELECT model, entity_id, event, crossed_fixed, ROUND(lead_fixed, 6) AS lead_fixed, method, ROUND(threshold_shift, 6) AS threshold_shift, ROUND(lead_delta_fixed, 6) AS lead_delta_fixed FROM rescored""")
def t03(t):
    df = K.rescore(stored(t), FIXED)
    return df.select(*MEE, "crossed_fixed", *r6(df, "lead_fixed"), "method", *r6(df, "threshold_shift", "lead_delta_fixed"))


B.add("lead_matrix", """SELECT c.model, c.entity_id, c.event, c.event >= '1998-01' AS in_scope, c.method, c.lead_months - b.lead_months AS lead_delta_own, c.lead_fixed - b.lead_months AS lead_delta_vs_baseline,
 COALESCE(ABS(c.lead_months - c.lead_fixed) <= 1.0, FALSE) AS stable FROM rescored c JOIN rescored b ON c.entity_id = b.entity_id AND c.event = b.event AND b.model = 'ensemble' AND c.model <> 'ensemble'""")


def matrix(t):
    rows = K.rescore(stored(t), FIXED)
    m = K.lead_matrix(rows.where("model <> 'ensemble'"), rows.where("model = 'ensemble'"), ["entity_id", "event"])
    return m.withColumn("in_scope", F.col("event") >= "1998-01")


@query("t04_lead_matrix", sql="""SELECT model, entity_id, event, in_scope, method, ROUND(lead_delta_own, 6) AS lead_delta_own, ROUND(lead_delta_vs_baseline, 6) AS lead_delta_vs_baseline, stable FROM lead_matrix""")
def t04(t):
    df = matrix(t)
    return df.select(*MEE, "in_scope", "method", *r6(df, "lead_delta_own", "lead_delta_vs_baseline"), "stable")


_GATE = """COUNT(*) FILTER (in_scope) AS n_events, COUNT(*) FILTER (in_scope AND lead_delta_vs_baseline IS NULL) AS n_unknown, COUNT(*) FILTER (in_scope AND lead_delta_vs_baseline < -2.0) AS n_violations,
 COUNT(*) FILTER (in_scope AND lead_delta_vs_baseline < -2.0) = 0 AS passed"""


@query("t05_gate", sql=f"SELECT model, entity_id, {_GATE} FROM lead_matrix GROUP BY 1, 2")
def t05(t):
    return K.stability_gate(matrix(t), ["model", "entity_id"]).select("model", "entity_id", "n_events", "n_unknown", "n_violations", "passed")


@query("t06_retroactive_gate", sql=f"SELECT e.model, COALESCE(n_events, 0) AS n_events, COALESCE(n_violations, 0) AS n_violations, COALESCE(passed, FALSE) AS passed FROM (SELECT DISTINCT model FROM score_panel) e LEFT JOIN (SELECT model, {_GATE} FROM lead_matrix GROUP BY 1) g ON e.model = g.model")
def t06(t):
    everyone = t.score_panel.select("model").distinct()
    gate = K.stability_gate(matrix(t), ["model"], everyone)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return gate.select("model", zero("n_events"), zero("n_violations"), "passed")


__all__ = ["V"]
