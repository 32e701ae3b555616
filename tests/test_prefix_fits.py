"""Fits from sums by month against fits from the rows themselves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import months
from pyspark.sql import functions as F

from tidegauge.operators import backtest as K
from tidegauge.operators import prefix_fits as PF

WIDTH = 4


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for e in "ABCDE":
        for d in months(70):
            x = rng.normal(size=WIDTH) * [1, 3, 0.5, 0] + [0, 5, -1, 2]
            out.append((e, d, [float(v) for v in x], float(x[0] + 0.3 * x[1] + rng.normal() > 1.5) if rng.random() > 0.05 else None))
    return spark.createDataFrame(out, "entity_id string, period_end date, x array<double>, y double")


def scratch(pdf: pd.DataFrame, most: int, l2: float):
    """The same fit from the training rows: standardise, keep the best correlated, ridge."""
    x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
    mean, spread = x.mean(0), x.std(0)
    z = np.where(spread > 1e-9, (x - mean) / np.where(spread > 1e-9, spread, 1), 0)
    order = [i for i in np.argsort(-np.round(np.abs(z.T @ (y - y.mean())) / len(y), 12), kind="stable")[:most] if spread[i] > 1e-9]
    coef = np.zeros(x.shape[1])
    k = sorted(order)
    coef[k] = np.linalg.solve(z[:, k].T @ z[:, k] + l2 * np.eye(len(k)), z[:, k].T @ (y - y.mean())) / spread[k]
    return y.mean() - coef @ mean, coef


CANDIDATES = [("all", 10, 10.0), ("two", 2, 0.5)]


def test_every_origin_equals_a_refit_from_scratch(spark, rows):
    cuts = [months(70)[i] for i in (37, 45, 69)] + [dt.date(1999, 5, 31), dt.date(1980, 1, 31)]
    monthly = PF.sums(rows, ["period_end"], WIDTH)
    cells = PF.up_to(monthly, spark.createDataFrame([(c,) for c in cuts], "cut date"), WIDTH)
    got = {(r["cut"], r["candidate_id"]): r for r in PF.fits(cells, ["cut"], CANDIDATES, WIDTH).collect()}
    pdf = rows.toPandas().dropna(subset=["y"])
    assert len(got) == len(cuts) * len(CANDIDATES)
    for cut in cuts:
        part = pdf[pdf["period_end"] <= cut]
        for name, most, l2 in CANDIDATES:
            r = got[cut, name]
            assert r["train_rows"] == len(part) and r["positives"] == part["y"].sum()
            if len(part) < 180:
                assert r["reason"] == "insufficient_history" and r["coef"] is None
                continue
            intercept, coef = scratch(part, most, l2)
            assert np.allclose(r["coef"], coef, atol=1e-9) and abs(r["intercept"] - intercept) < 1e-9
            assert sum(c != 0 for c in r["coef"]) == min(most, WIDTH - 1)


def test_one_class_training_sets_keep_a_reason(rows):
    one = rows.withColumn("y", F.lit(1.0)).withColumn("k", F.lit("a"))
    fit = PF.fits(PF.sums(one, ["k"], WIDTH), ["k"], CANDIDATES, WIDTH).collect()
    assert [(r["reason"], r["coef"]) for r in fit] == [("one_class", None)] * 2


def test_scores_and_own_thresholds(spark, rows):
    keyed = rows.withColumn("k", F.lit("a"))
    fit = PF.fits(PF.sums(keyed, ["k"], WIDTH), ["k"], CANDIDATES[:1], WIDTH)
    scored = PF.scores(keyed.where("y is not null"), fit, ["k"]).toPandas()
    intercept, coef = scratch(rows.toPandas().dropna(subset=["y"]), 10, 10.0)
    want = {(r.entity_id, r.period_end): np.clip(intercept + np.dot(r.x, coef), PF.LOW, PF.HIGH) for r in rows.toPandas().itertuples()}
    assert all(abs(p - want[e, d]) < 1e-9 for e, d, p in zip(scored["entity_id"], scored["period_end"], scored["prob"].astype(float)))
    chosen = PF.own_thresholds(PF.scores(keyed.where("y is not null"), fit, ["k"]), ["k"]).first()["threshold"]

    def f1(t):
        hit, y = scored["prob"].astype(float) >= t, scored["y"] == 1
        return round(2 * (hit & y).sum() / (hit.sum() + y.sum()), 12)

    assert f1(chosen) == max(f1(i / 100) for i in range(10, 61))


def test_vectors_carry_values_forward(spark):
    d = months(4)
    long = spark.createDataFrame(
        [("A", d[0], "f", 2.0), ("A", d[1], "f", None), ("A", d[2], "f", 4.0), ("A", d[0], "g", None), ("A", d[3], "g", 7.0)], "entity_id string, period_end date, feature string, value double")
    scale = spark.createDataFrame([("f", 0.0, 2.0), ("g", 1.0, 1.0)], "feature string, at double, by double")
    got = [r["x"] for r in PF.vectors(long, ["f", "g", "h"], scale).orderBy("period_end").collect()]
    assert got == [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 6.0, 0.0]]


def test_months_whose_label_was_known(spark):
    d = months(12)
    origins = spark.createDataFrame([(d[8], d[0]), (d[3], d[0])], "origin date, first date")
    got = sorted((r["origin"], r["period_end"]) for r in PF.training_months(origins, "first", 6).collect())
    assert got == [(d[8], m) for m in d[:3]]


def test_windows_meet_scores_by_month(spark):
    d = months(30)
    scores = spark.createDataFrame([("A", m, 0.1 * (i % 7), float(i % 2), 0.5) for i, m in enumerate(d)], "entity_id string, period_end date, prob double, y double, threshold double")
    windows = spark.createDataFrame([("A", "e1", d[4], d[10], d[12]), ("A", "e2", d[8], d[20], d[20])], "entity_id string, event string, train_end date, start_month date, end_month date")
    rows = {r["event"]: r for r in K.event_results(scores.withColumn("model", F.lit("m")), windows, ["model"], 0.45).collect()}
    assert (rows["e1"]["test_months"], rows["e2"]["test_months"]) == (8, 12)
    assert rows["e1"]["first_signal"] == d[5] and abs(rows["e2"]["peak_prob"] - 0.6) < 1e-12
    own = scores.withColumns({"model": F.lit("m"), "event": F.lit("e1")}).unionByName(scores.withColumns({"model": F.lit("m"), "event": F.lit("e2")}))
    joined = {r["event"]: r for r in K.event_results(own, windows, ["model"], 0.45).collect()}
    assert joined == rows
