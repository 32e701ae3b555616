import numpy as np
import pandas as pd
import pytest
from helpers import column, panel
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import align


def w():
    return W.series_window()


def near(a, b):
    return all((x is None and (y is None or np.isnan(y))) or x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a, b, strict=True))


def test_expanding_z_needs_history_and_variance(spark):
    ramp = column(panel(spark, {"x": list(range(24))}).withColumn("z", W.expanding_z("value", w(), 12)), "z")
    assert ramp[:11] == [None] * 11 and ramp[11] is not None
    flat = column(panel(spark, {"x": [5.0] * 20}).withColumn("z", W.expanding_z("value", w(), 12)), "z")
    assert flat == [None] * 20


def test_expanding_z_equals_pandas_and_never_looks_ahead(spark):
    values = np.random.default_rng(1).normal(size=48)
    s = pd.Series(values)
    want = ((s - s.expanding(12).mean()) / s.expanding(12).std()).tolist()
    full = column(panel(spark, {"x": list(values)}).withColumn("z", W.expanding_z("value", w(), 12)), "z")
    short = column(panel(spark, {"x": list(values[:30])}).withColumn("z", W.expanding_z("value", w(), 12)), "z")
    assert near(full, want) and full[:30] == short


def test_tertile_states(spark):
    values = list(np.random.default_rng(2).normal(size=120))
    df = panel(spark, {"x": values}).withColumns({
        "low": W.rolling_quantile("value", 0.33, 60, w(), 12), "high": W.rolling_quantile("value", 0.67, 60, w(), 12)})
    states = column(df.withColumn("s", W.tertile_state("value", "low", "high")), "s")
    assert states[:11] == [None] * 11 and {"weak", "neutral", "strong"} == set(states[11:])
    same = panel(spark, {"x": [1.0] * 20}).withColumns({
        "low": W.rolling_quantile("value", 0.33, 60, w(), 12), "high": W.rolling_quantile("value", 0.67, 60, w(), 12)})
    assert column(same.withColumn("s", W.tertile_state("value", "low", "high")), "s")[-1] == "strong"


def test_run_length_resets(spark):
    df = panel(spark, {"x": [0, 1, 1, 0, 1, 1, 1, 0, None, 1]}).withColumn("rn", W.position(w()))
    assert column(df.withColumn("d", W.run_length(F.col("value") == 1.0, w())), "d") == [0, 1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_percent_change_over_gaps(spark):
    df = panel(spark, {"x": [1, 2, None, 4, 0, 3]}).withColumn("p", W.ffill("value", w()))
    assert column(df.withColumn("c", W.pct_change("value", 1, w())), "c") == [None, 1.0, None, None, -1.0, None]
    assert column(df.withColumn("c", W.pct_change("p", 1, w(), fill="pad")), "c")[:4] == [None, 1.0, 0.0, 1.0]


def test_interpolation_equals_pandas(spark):
    values = [None, None, 3, None, None, 9, None, None, 6, None, None, None]
    want = pd.Series(values, dtype=float).interpolate("linear").tolist()
    assert near(column(align.interpolate_quarterly(panel(spark, {"x": values})), "value"), want)
    dense = [1, 2, None, 4, 5, 6]
    assert column(align.interpolate_quarterly(panel(spark, {"x": dense})), "value")[2] is None


def test_dense_calendar_fills_gaps_at_both_ends(spark):
    df = panel(spark, {"x": [1, 2, 3, 4, 5], "y": [9, 8, 7, 6, 5]})
    holes = df.where("not (series_id = 'y' and value in (9, 7, 5))")
    out = align.dense_calendar(holes).where("series_id = 'y'")
    assert column(out, "value") == [None, 8.0, None, 6.0, None]


def test_lag_mask_modes(spark):
    df = panel(spark, {"x": [1, 2, 3, 4], "RECESSION": [0, 0, 1, 1]})
    lags = spark.createDataFrame([("x", 2)], "series_id STRING, lag_months INT")
    tail = align.lag_mask(df, lags)
    assert column(tail.where("series_id = 'x'"), "value") == [1.0, 2.0, None, None]
    assert column(tail.where("series_id = 'RECESSION'"), "value") == [0.0, 0.0, 1.0, 1.0]
    assert column(align.lag_mask(df, lags, mode="shift").where("series_id = 'x'"), "value") == [None, None, 1.0, 2.0]


def test_entities_do_not_touch_each_other(spark):
    values = list(np.random.default_rng(3).normal(size=40))
    a, b = panel(spark, {"x": values}), panel(spark, {"x": values[::-1]}, "B")
    z = W.expanding_z("value", w(), 12)
    both = a.unionByName(b).orderBy(F.rand(7)).withColumn("z", z).where("entity_id = 'A'")
    assert column(both, "z") == column(a.withColumn("z", z), "z")
