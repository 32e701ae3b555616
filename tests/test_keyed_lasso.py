"""Keyed L1 logistic fits against their optimality conditions."""

import numpy as np
import pytest

from tidegauge.operators import keyed_lasso as L

WIDTH, C = 6, 0.3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for key, size, tilt in (("a", 300, 1.5), ("b", 80, 0.2), ("sharp", 120, 30.0)):
        x = rng.normal(size=(size, WIDTH))
        x[:, 4] = x[:, 0] + 0.05 * rng.normal(size=size)
        x[:, 5] = 3.0
        p = 1 / (1 + np.exp(-tilt * (x[:, 0] - 0.5 * x[:, 1])))
        out += [(key, [float(v) for v in r], float(rng.random() < q), float(1 + i % 3)) for i, (r, q) in enumerate(zip(x, p))]
    return spark.createDataFrame([*out, ("one", [1.0] * WIDTH, 1.0, 1.0), ("a", [9.0] * WIDTH, None, 1.0)], "key string, x array<double>, y double, wt double")


def kkt(x, y, w, coef):
    """Largest violation of the optimality conditions."""
    eta = coef[0] + x @ coef[1:]
    g = C * (np.concatenate([np.ones((len(x), 1)), x], 1).T @ (w * (y - 1 / (1 + np.exp(-eta)))))
    return max(abs(g[0]), *(abs(g[j] - np.sign(b)) if b else max(0.0, abs(g[j]) - 1) for j, b in enumerate(coef[1:], 1)))


@pytest.mark.parametrize("weight", [None, "wt"])
def test_optimality_of_every_key(rows, weight):
    scaled = L.standardised(rows.where("y is not null"), ["key"], WIDTH)
    got = {r["key"]: r for r in L.fit(scaled, ["key"], WIDTH, C=C, weight=weight).collect()}
    assert set(got) == {"a", "b", "sharp"} and all(r["converged"] for r in got.values())
    for key, part in scaled.toPandas().groupby("key"):
        if key == "one":
            continue
        x = np.stack(part["x"].to_numpy())
        w = part["wt"].to_numpy() if weight else np.ones(len(part))
        assert kkt(x, part["y"].to_numpy(), w, np.array(got[key]["coef"])) < 1e-4
        assert got[key]["coef"][6] == 0.0  # no spread
        assert sum(c == 0 for c in got[key]["coef"]) >= 2


def test_scores(rows):
    scaled = L.standardised(rows.where("y is not null"), ["key"], WIDTH)
    fitted = L.fit(scaled, ["key"], WIDTH, C=C)
    coef = {r["key"]: np.array(r["coef"]) for r in fitted.collect()}
    for r in L.score(scaled, fitted, ["key"]).collect():
        want = None if r["key"] == "one" else 1 / (1 + np.exp(-coef[r["key"]][0] - np.dot(r["x"], coef[r["key"]][1:])))
        assert r["prob"] is None if want is None else abs(r["prob"] - want) < 1e-9


def test_coordinate_descent_solves_the_quadratic_model():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 5))
    h, grad = a.T @ a, rng.normal(size=5) * 20
    b = L.descend(h, grad, np.zeros(5), 3.0)
    slope = grad - h @ b
    assert abs(slope[0]) < 1e-6
    assert all(abs(s - 3 * np.sign(v)) < 1e-6 if v else abs(s) <= 3 + 1e-6 for s, v in zip(slope[1:], b[1:]))
