import datetime as dt

import numpy as np
import pytest
from helpers import column, months, panel
from pyspark.sql import functions as F

from tidegauge.functions.ordered import cumulate, exact_quantiles, score_cells
from tidegauge.operators import align, backtest, composites, ensemble, keyed_logit, labels, metrics, selection, uncertainty
from tidegauge.operators import calibration as C
from tidegauge.operators import features as X
from tidegauge.sources import catalog, observations, stores
from tidegauge.sources.catalog import dimension


def test_registry_counts(spark):
    spec = catalog.composite_spec(spark).groupBy("composite").count().collect()
    assert {r["composite"]: r["count"] for r in spec} == {"growth": 10, "liquidity": 7, "risk": 6}
    assert len(catalog.series_rows()) == 59 and len(catalog.VARIANTS) == 6


def test_composites_formulas_sign_and_missing_source(spark):
    rng = np.random.default_rng(42)
    walk = lambda: list(100 + np.cumsum(rng.normal(size=60)))
    series = {"glr_VIXCLS": walk(), "glr_VXVCLS": walk(), "glr_PCOPPUSDM": walk(), "glr_IQ12260": walk(), "glr_WALCL": walk()}
    parts = composites.components(panel(spark, series), catalog.composite_spec(spark))
    got = {n: column(parts.where(F.col("component") == n), "z") for n in ("risk_VIXCLS_neg", "risk_vix_term_struct", "risk_copper_gold_ratio", "liquidity_net_liquidity_level")}

    def z(x):
        x = np.asarray(x)
        return [None if i < 11 else (x[i] - x[: i + 1].mean()) / x[: i + 1].std(ddof=1) for i in range(len(x))]

    v, m = np.array(series["glr_VIXCLS"]), np.array(series["glr_VXVCLS"])
    assert got["risk_VIXCLS_neg"][20:] == pytest.approx([-x for x in z(v)[20:]])
    assert got["risk_vix_term_struct"][20:] == pytest.approx(z(1 - v / m)[20:])
    assert got["risk_copper_gold_ratio"][20:] == pytest.approx(z(np.array(series["glr_PCOPPUSDM"]) / np.array(series["glr_IQ12260"]))[20:])
    assert set(got["liquidity_net_liquidity_level"]) == {None}
    level = composites.composites(parts).where("composite = 'risk'")
    last = parts.where("composite = 'risk'").groupBy("period_end").agg(F.avg("z").alias("z"))
    assert column(level, "value")[20:] == pytest.approx(column(last, "z")[20:])


def test_forward_label_covers_next_months_only(spark):
    flags = panel(spark, {"f": [0, 0, 1, 1, 0, 0, 0, 0]}).withColumnRenamed("value", "flag")
    assert column(labels.forward_label(flags, 3), "y") == [1.0, 1.0, 1.0, 0.0, 0.0, None, None, None]


def test_no_label_beyond_origin_minus_horizon(spark):
    rows = [("A", d, 0.0, dt.date(2010, 6, 30)) for d in months(300)]
    frame = catalog.dimension(spark, rows, "entity_id STRING, period_end DATE, y DOUBLE, origin DATE")
    last = backtest.strict_frames(frame, 6).where("role = 'train'").agg(F.max("period_end").alias("d")).first()["d"]
    assert last == dt.date(2009, 12, 31)


def test_aligned_candidate_outranks_inverted(spark):
    rows = [("good", o, y, 0.8 if y else 0.2) for o in range(6) for y in (0.0, 1.0)] + [("bad", o, y, 0.2 if y else 0.8) for o in range(6) for y in (0.0, 1.0)]
    df = catalog.dimension(spark, rows, "candidate_id STRING, origin INT, actual DOUBLE, prob DOUBLE").withColumns({
        "threshold": F.lit(0.5), "signal": (F.col("prob") >= 0.5).cast("int"), "train_rows": F.lit(200)})
    ranked = backtest.rank_candidates(backtest.origin_summary(df, ["candidate_id"]))
    assert [r["candidate_id"] for r in ranked.orderBy("rank").collect()] == ["good", "bad"]


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_rank_metrics_with_a_hot_key_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("hot", 900), ("b", 60), ("c", 40)):
        p = np.round(rng.beta(1, 20, n), 3)
        y = (rng.random(n) < 0.3).astype(float)
        rows += [(key, float(a), float(b)) for a, b in zip(p, y)]
    df = catalog.dimension(spark, rows, "k STRING, prob DOUBLE, y DOUBLE")
    got = {r["k"]: r for r in metrics.metrics_table(df, ["k"], 0.05).collect()}
    for key in ("hot", "b", "c"):
        p, y = (np.array([r[i] for r in rows if r[0] == key]) for i in (1, 2))
        assert got[key]["auc"] == pytest.approx(brute_auc(y, p))
        cuts = sorted(set(p), reverse=True)
        recall = [0.0] + [(y[p >= c]).sum() / y.sum() for c in cuts]
        ap = sum((recall[i + 1] - recall[i]) * y[p >= c].mean() for i, c in enumerate(cuts))
        assert got[key]["pr_auc"] == pytest.approx(ap)
        assert got[key]["brier"] == pytest.approx(np.mean((p - y) ** 2))


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([np.full(200, 0.5), rng.random(301) * 1e-4, rng.random(50)])
    df = catalog.dimension(spark, [("x", float(v), 1.0) for v in values], "k STRING, prob DOUBLE, y DOUBLE")
    cells = score_cells(df, ["k"]).withColumn("n", F.col("tp") + F.col("fp"))
    qs = [0.0, 0.1, 0.33, 0.5, 0.95, 1.0]
    assert exact_quantiles(cells, ["k"], qs).first()["q"] == pytest.approx(np.quantile(values, qs))
    total = cumulate(cells, ["k"], ["n"]).agg(F.max("c_n").alias("c"), F.max("t_n").alias("t")).first()
    assert total["c"] == total["t"] == len(values)


def test_one_class_metric_is_null(spark):
    df = catalog.dimension(spark, [("a", 0.2, 0.0), ("a", 0.4, 0.0)], "k STRING, prob DOUBLE, y DOUBLE")
    row = metrics.metrics_table(df, ["k"]).first()
    assert row["auc"] is None and row["pr_auc"] is None
    assert ensemble.choose_threshold(ensemble.threshold_sweep(df, ["k"]), ["k"]).first()["threshold"] == 0.5


def test_threshold_grid_is_exact(spark):
    df = catalog.dimension(spark, [(i / 100.0,) for i in range(0, 101)] + [(0.29999999999999993,)], "prob DOUBLE")
    got = [r["i"] for r in df.select(ensemble.grid_index().alias("i")).collect()]
    assert got == [*range(0, 101), 29]


def test_cap_and_floor(spark):
    rows = [("r", "a", 0.9), ("r", "b", 0.07), ("r", "c", 0.02), ("r", "d", 0.01)]
    w = {k: v for _, k, v in rows}
    for _ in range(3):
        for k in w:
            if w[k] > 0.4:
                rest = sum(v for j, v in w.items() if j != k)
                extra = w[k] - 0.4
                w = {j: 0.4 if j == k else v + extra * v / rest for j, v in w.items()}
    w = {k: max(v, 0.02) for k, v in w.items()}
    want = {k: v / sum(w.values()) for k, v in w.items()}
    got = ensemble.cap_and_floor(catalog.dimension(spark, rows, "run STRING, model STRING, weight DOUBLE"), ["run"]).collect()
    assert {r["model"]: r["weight"] for r in got} == pytest.approx(want)


def test_promotion_gate(spark):
    cols = [f"{s}_{m}" for s in ("candidate", "incumbent") for m in ensemble.GATE]
    ddl = "run STRING, " + ", ".join(f"{c} DOUBLE" for c in cols)
    rows = [("up", 0.8, 0.5, 0.1, 0.3, 0.7, 0.5, 0.1, 0.3), ("down", 0.8, 0.5, 0.2, 0.3, 0.7, 0.5, 0.1, 0.3), ("same", *[0.5] * 8), ("nan", None, *[0.5] * 7)]
    got = {r["run"]: r for r in ensemble.promotion_gate(catalog.dimension(spark, rows, ddl), ["run"]).collect()}
    assert got["up"]["passed"] and got["same"]["reason"] == "matched incumbent on all guardrails"
    assert not got["down"]["passed"] and got["down"]["reason"].endswith("brier") and got["nan"]["reason"].endswith(" auc")


def test_slope_recovers_a_distorted_calibration(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=6000)
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.5 * x - 0.3)))
    df = catalog.dimension(spark, [("k", float(1 / (1 + np.exp(-a))), float(b)) for a, b in zip(x, y)], "k STRING, prob DOUBLE, y DOUBLE")
    fit = C.slope_intercept(df, ["k"]).first()
    assert fit["slope"] == pytest.approx(0.5, abs=0.08) and fit["intercept"] == pytest.approx(-0.3, abs=0.08)
    raw = C.calibration_error(df, ["k"]).first()["ece"]
    done = C.apply_sigmoid(df, C.slope_intercept(df, ["k"]), ["k"]).select("k", "y", F.col("calibrated").alias("prob"))
    assert C.calibration_error(done, ["k"]).first()["ece"] < raw
    parts = C.brier_parts(df, ["k"]).first()
    assert parts["brier_total"] == pytest.approx(parts["reliability"] - parts["resolution"] + parts["uncertainty"])


def test_keyed_logit_fits_every_key_like_a_single_fit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0])))).astype(float)
    rows = [(k, float(a), float(b), float(c)) for k in ("one", "two") for (a, b), c in zip(x, y)]
    df = catalog.dimension(spark, rows, "k STRING, x1 DOUBLE, x2 DOUBLE, y DOUBLE")
    coef = {r["k"]: np.array(r["coef"]) for r in keyed_logit.fit(df, ["k"], ["x1", "x2"], l2=1.0).collect()}
    d = np.c_[np.ones(400), x]
    b = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), d.T @ (y - p) - np.array([0, 1, 1]) * b)
    assert coef["one"] == pytest.approx(b, abs=1e-6) and coef["two"] == pytest.approx(coef["one"])


def test_bootstrap_blocks_and_final_band(spark):
    rows = catalog.dimension(spark, [("A", i + 1, 60) for i in range(60)], "entity_id STRING, rn INT, n INT")
    draws = uncertainty.bootstrap_indices(rows, 40).orderBy("replicate", "position").collect()
    idx = np.array([r["rn"] for r in draws]).reshape(40, 60)
    assert idx.min() >= 1 and idx.max() <= 60
    steps = ((idx[:, 1:] - idx[:, :-1]) % 60 == 1).mean()
    assert 0.85 < steps < 0.97
    band = catalog.dimension(spark, [(0.0, 0.0, 0.0, 0.0, 0.0), (0.5, 0.01, 0.49, 0.51, 0.2), (1.0, 0.0, 1.0, 1.0, 0.0)],
                             "boot_mean DOUBLE, boot_std DOUBLE, raw_lower DOUBLE, raw_upper DOUBLE, member_std DOUBLE")
    got = uncertainty.final_band(band).collect()
    assert [r["ci_upper"] - r["ci_lower"] for r in got] == pytest.approx([0.06, 0.4, 0.06])
    assert all(0 <= r["ci_lower"] <= r["ci_upper"] <= 1 for r in got)


def test_greedy_selection_is_deterministic_and_breaks_ties_by_name():
    names = ["a", "b", "c", "d"]
    corr = np.eye(4)
    corr[0, 1] = corr[1, 0] = 0.99
    assert selection.greedy_select(names, corr, 2) == ["a", "c"]
    assert selection.greedy_select(names, corr, 4) == ["a", "c", "d", "b"]
    assert selection.greedy_select(names, corr, 2, required=["d"], available={"d"}) == ["a", "d"]
    assert selection.greedy_select(names, corr, 2, severe={"a"}) == ["b", "c"]


def test_candidate_pool_tie_break(spark):
    rows = [("e", n, 0.5, 200) for n in ("gamma", "alpha", "beta")] + [("e", "delta", 0.9, 200)]
    ranked = selection.candidate_pool(catalog.dimension(spark, rows, "entity_id STRING, feature STRING, abs_corr DOUBLE, n INT"), ["entity_id"], 10)
    assert [r["feature"] for r in ranked.orderBy("rank").collect()] == ["delta", "alpha", "beta", "gamma"]


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(size=60)
    df = panel(spark, {"x": list(values)}).withColumnRenamed("series_id", "feature")
    ref, rec = values[-36:-12], values[-12:]
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    a, b = np.histogram(ref, edges)[0] + 1e-4, np.histogram(rec, edges)[0] + 1e-4
    a, b = a / a.sum(), b / b.sum()
    got = selection.psi(df, ["entity_id"], **selection.PSI_MONITOR).first()["psi"]
    assert got == pytest.approx(max(0.0, float(np.sum((b - a) * np.log(b / a)))))


def test_rescore_methods(spark):
    d = months(6)
    tr = lambda ps: [{"period_end": a, "prob": p} for a, p in zip(d, ps)]
    ac = [{"period_end": a, "y": float(i >= 4)} for i, a in enumerate(d)]
    rows = [("exact", 0.9, 0.5, 1.0, tr([0.1, 0.5, 0.6, 0.9, 0.2, 0.1]), ac), ("never", 0.3, 0.2, 1.0, tr([0.1] * 6), ac), ("low", 0.3, 0.2, 1.0, None, None),
            ("earlier", 0.9, 0.6, 2.0, None, None), ("later", 0.9, 0.2, 2.0, None, None), ("unknown", 0.9, 0.95, None, None, None), ("none", None, 0.5, None, None, None)]
    ddl = ("event STRING, peak_prob DOUBLE, threshold DOUBLE, lead_months DOUBLE, trajectory ARRAY<STRUCT<period_end: DATE, prob: DOUBLE>>, "
           "actual ARRAY<STRUCT<period_end: DATE, y: DOUBLE>>")
    got = {r["event"]: r for r in backtest.rescore(catalog.dimension(spark, rows, ddl), 0.45).collect()}
    assert {k: r["method"] for k, r in got.items()} == {
        "exact": "exact", "never": "exact_no_cross", "low": "exact_no_cross", "earlier": "bound_at_or_earlier", "later": "bound_at_or_later",
        "unknown": "bound_unknown", "none": "unavailable"}
    assert got["exact"]["lead_fixed"] == pytest.approx((d[4] - d[1]).days / 30.44)


def test_feature_rows_and_variants(spark):
    rng = np.random.default_rng(12)
    df = panel(spark, {n: list(50 + rng.normal(size=72)) for n in ("leading_T10Y3M", "coincident_JTSJOL", "coincident_UNEMPLOY", "ref_JHGDPBRINDX")})
    long = X.engineer(df)
    names = {r["feature"] for r in long.select("feature").distinct().collect()}
    assert {"leading_T10Y3M_MoM", "leading_T10Y3M_AT_RISK", "AT_RISK_DIFFUSION", "VU_RATIO"} <= names and "ref_JHGDPBRINDX_MoM" not in names
    variants = {(r["variant"], r["feature"]) for r in X.with_variants(long).select("variant", "feature").distinct().collect()}
    assert ("hybrid_no_b2_labor", "VU_RATIO") not in variants and ("hybrid", "VU_RATIO") in variants
    assert ("continuous_only", "AT_RISK_DIFFUSION") not in variants and ("at_risk_only", "ref_JHGDPBRINDX") in variants


def test_payload_parsing_and_contract(spark):
    text = '{"observations": [{"date": "2020-01-31", "value": "1.5"}, {"date": "oops", "value": "2"}, {"date": "2020-02-29", "value": "."}]}'
    df = catalog.dimension(spark, [("A", "x", text)], "entity_id STRING, series_id STRING, payload STRING")
    rows = observations.parse_payload(df).orderBy("obs_date").collect()
    assert [(r["obs_date"], r["value"]) for r in rows] == [(dt.date(2020, 1, 31), 1.5), (dt.date(2020, 2, 29), None)]
    with pytest.raises(Exception, match="critical series"):
        observations.require_series(panel(spark, {"x": [1]}), "label").collect()


def test_incumbent_defaults(spark):
    rows = [("2", None, "many", "?"), ("1", "old", "10", "3")]
    got = stores.incumbent(catalog.dimension(spark, rows, "run_id STRING, candidate_id STRING, max_features STRING, n_cv_splits STRING")).first()
    assert (got["candidate_id"], got["max_features"], got["n_cv_splits"]) == ("baseline_50", 50, 5)


def test_lags_of_any_length_are_shifted(spark):
    rows = panel(spark, {"slow": list(range(20)), "fast": list(range(20))})
    lags = dimension(spark, [("slow", 14), ("fast", 0)], "series_id STRING, lag_months INT")
    shifted = align.lag_mask(rows, lags, mode="shift")
    assert column(shifted.where("series_id = 'slow'"), "value") == [None] * 14 + [float(i) for i in range(6)]
    assert column(shifted.where("series_id = 'fast'"), "value") == [float(i) for i in range(20)]


def test_shared_history_agrees_for_long_lags(spark):
    rows = panel(spark, {"slow": [float(i * i % 17) for i in range(60)], "fast": [float(i) for i in range(60)]})
    lags = dimension(spark, [("slow", 14), ("fast", 0)], "series_id STRING, lag_months INT")
    ends = [r["period_end"] for r in rows.where("series_id = 'fast'").orderBy("period_end").collect()]
    origins = dimension(spark, [(ends[40],), (ends[-1],)], "origin DATE")

    cols = ["origin", "entity_id", "feature", "period_end", "value"]
    plain, shared = (f(rows, origins, lags).select(*cols) for f in (backtest.realtime_features, backtest.realtime_features_shared))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, shared.collect()), key=repr)


def test_components_read_all_their_sources(spark):
    rows = panel(spark, {n: [float((i * k) % 13) for i in range(40)] for k, n in enumerate("abcd", 2)})
    spec = catalog.composite_spec(spark, [("net", ("a", "b", "c", "d"), "level", 1, "growth"), ("gap", ("a", "missing"), "level", 1, "growth")])
    parts = composites.components(rows, spec)
    level = [float((i * 2) % 13 - (i * 3) % 13 - (i * 4) % 13 - (i * 5) % 13) for i in range(40)]
    wide = panel(spark, {"net": level})
    expected = composites.components(wide, catalog.composite_spec(spark, [("net", ("net",), "zscore", 1, "growth")]))
    assert column(parts.where("component = 'net'"), "z") == column(expected, "z")
    assert set(column(parts.where("component = 'gap'"), "z")) == {None}


def test_fits_report_whether_they_converged(spark):
    """Separable labels push the coefficients away without end; the others settle."""
    rows = [("apart", 0.1 + 0.02 * i, float(i >= 20)) for i in range(40)] + [("mixed", 0.1 + 0.02 * i, float(i % 3 == 0)) for i in range(40)]
    df = dimension(spark, rows, "k STRING, prob DOUBLE, y DOUBLE")
    done = {r["k"]: r["converged"] for r in C.slope_intercept(df, ["k"], most_steps=12).collect()}
    assert done == {"apart": False, "mixed": True}
    keyed = {r["k"]: r["converged"] for r in keyed_logit.fit(df, ["k"], ["prob"], l2=1.0).collect()}
    assert keyed == {"apart": True, "mixed": True}
    scored = keyed_logit.score(dimension(spark, [("mixed", 0.5), ("unknown", 0.5)], "k STRING, prob DOUBLE"), keyed_logit.fit(df, ["k"], ["prob"]), ["k"], ["prob"], "p")
    assert {r["k"]: r["p"] is None for r in scored.collect()} == {"mixed": False, "unknown": True}


def test_caps_follow_the_given_order(spark):
    rows = [("r", "a", 1, 0.5), ("r", "b", 0, 0.45), ("r", "c", 2, 0.05)]
    df = dimension(spark, rows, "run_id STRING, model STRING, place INT, weight DOUBLE")
    by_name = {r["model"]: r["weight"] for r in ensemble.cap_and_floor(df, ["run_id"], passes=1).collect()}
    by_place = {r["model"]: r["weight"] for r in ensemble.cap_and_floor(df, ["run_id"], passes=1, order="place").collect()}
    assert by_name["b"] == pytest.approx(0.4) and by_name["a"] > 0.4
    assert by_place["a"] == pytest.approx(0.4) and by_place["b"] > 0.4
