"""The regime fit stops at its tolerance and says so; its likelihood never falls."""

import datetime as dt

import numpy as np
import pytest

from tidegauge.operators import models as M


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for entity in "ab":
        low = np.repeat(rng.random(12) < 0.4, 15)
        rows += [(entity, dt.date(1990 + i // 12, i % 12 + 1, 28), float(v)) for i, v in enumerate(np.where(low, -2.0, 1.0) + rng.normal(0, 0.5, len(low)))]
    return M.pack_series(spark.createDataFrame(rows, "entity_id string, period_end date, composite double"))


def test_converges(packed):
    fit = M.fit_regimes(packed, k=2)
    assert fit["converged"] and fit["steps"] < 50
    assert sorted(fit["mean"]) == pytest.approx([-2.0, 1.0], abs=0.3)
    table = M.regime_table(packed.sparkSession, fit).collect()
    assert [r["converged"] for r in table] == [True, True] and [r["is_expansion"] for r in table] == [True, False]


def test_likelihood_never_falls(packed):
    logs = [M.fit_regimes(packed, k=2, iterations=n, tolerance=0.0) for n in (1, 2, 4, 8)]
    assert not any(f["converged"] for f in logs)
    assert all(b["loglik"] >= a["loglik"] - 1e-9 for a, b in zip(logs, logs[1:]))
