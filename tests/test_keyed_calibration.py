"""Calibrators fitted for many keys at once, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import calibration as C
from tidegauge.operators import isotonic as I


def min_max(p, y):
    """Value of the monotone fit at each distinct score: the quadratic formula."""
    xs = sorted(set(p))
    n = np.array([sum(a == x for a in p) for x in xs], float)
    t = np.array([sum(b for a, b in zip(p, y) if a == x) for x in xs], float)
    mean = lambda a, b: t[a : b + 1].sum() / n[a : b + 1].sum()
    return xs, [max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    out = {}
    for key, size in (("a", 400), ("b", 60), ("c", 5), ("one", 30), ("same", 12)):
        p = np.round(rng.random(size), 2 if key == "a" else 4) if key != "same" else np.full(size, 0.3)
        y = (rng.random(size) < 0.2 + 0.6 * p).astype(float) if key != "one" else np.ones(size)
        out[key] = (p.tolist(), y.tolist())
    return out


@pytest.fixture(scope="module")
def scores(spark, data):
    rows = [(k, float(p), float(y)) for k, (ps, ys) in data.items() for p, y in zip(ps, ys)]
    return spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 0.5, None)], "key string, prob double, y double")


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_keyed_maps_equal_the_min_max_formula(spark, scores, data, monkeypatch, ranges):
    monkeypatch.setattr(I, "RANGES", ranges)
    target = scores.select("key", "prob").distinct()
    got = {(r["key"], r["prob"]): r["calibrated"] for r in C.isotonic(scores, target, keys=["key"]).collect()}
    for key, (p, y) in data.items():
        for x, v in zip(*min_max(p, y)):
            assert abs(got[key, x] - min(0.99, max(0.01, v))) < 1e-12
    assert got["a", None] is None


def test_between_and_beyond_the_blocks(spark, scores, data):
    wanted = [0.0, 0.001, 0.1234567, 0.5, 0.77777, 0.999, 1.0]
    target = spark.createDataFrame([(k, w) for k in data for w in wanted] + [("new", 0.4), ("new", 0.001)], "key string, prob double")
    got = {(r["key"], r["prob"]): r["calibrated"] for r in C.isotonic(scores, target, keys=["key"]).collect()}
    for key, (p, y) in data.items():
        assert [got[key, w] for w in wanted] == pytest.approx([min(0.99, max(0.01, v)) for v in np.interp(wanted, *min_max(p, y))], abs=1e-12)
    assert got["new", 0.4] == 0.4 and got["new", 0.001] == 0.01
    assert C.isotonic(scores, target, keys=["key"]).count() == target.count()


def test_pooling_twice_is_pooling_once():
    rng = np.random.default_rng(2)
    cells = [(x, x, 1.0 + rng.integers(3), float(rng.integers(2))) for x in sorted(rng.random(200))]
    once: list = []
    for c in cells:
        I.pool(once, *c)
    twice: list = []
    for start in range(0, 200, 23):
        part: list = []
        for c in cells[start : start + 23]:
            I.pool(part, *c)
        for block in part:
            I.pool(twice, *block)
    assert once == twice and all(a[3] / a[2] < b[3] / b[2] for a, b in zip(once, once[1:]))


def test_without_a_key_all_rows_share_a_map(scores, data):
    rows = scores.where("prob is not null and y is not null").drop("key")
    p, y = (sum((v[k] for v in data.values()), []) for k in (0, 1))
    got = {r["prob"]: r["calibrated"] for r in C.isotonic(rows, rows).collect()}
    assert all(abs(got[x] - min(0.99, max(0.01, v))) < 1e-12 for x, v in zip(*min_max(p, y)))


def beta_fit(p, y, use):
    """Newton on the chosen terms."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.stack([np.ones(len(q)), *[(np.log(q), -np.log(1 - q))[u] for u in use]], 1)
    b = np.zeros(x.shape[1])
    for _ in range(200):
        mu = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]) + 1e-9 * np.eye(len(b)), x.T @ (y - mu))
        b += step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return b, 1 / (1 + np.exp(-x @ b))


def test_keyed_beta_maps(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key, curve in (("up", lambda p: p**2), ("half", lambda p: 0.5 + 0.4 * (p - 0.5) ** 3), ("late", lambda p: np.where(p > 0.8, 0.9, 0.3 - 0.2 * p))):
        p = np.round(rng.random(600) * 0.98 + 0.01, 3)
        y = (rng.random(600) < curve(p)).astype(float)
        b, prob = beta_fit(p, y, (0, 1))
        if b[1] < 0 or b[2] < 0:
            _, prob = beta_fit(p, y, (1,) if b[1] < 0 else (0,))
        want.update({(key, i): v for i, v in enumerate(prob)})
        rows += [(key, i, float(a), float(c)) for i, (a, c) in enumerate(zip(p, y))]
    df = spark.createDataFrame(rows, "key string, i int, prob double, y double")
    got = {(r["key"], r["i"]): r["calibrated"] for r in C.beta(df, df, keys=["key"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5
    alone = C.beta(df.withColumn("y", F.lit(1.0)), df, keys=["key"])
    assert alone.where("abs(calibrated - greatest(0.01, least(0.99, prob))) > 1e-12").count() == 0


def test_comparison_is_made_per_key(spark, scores):
    from pyspark.sql import Window

    w = Window.partitionBy("key")
    rows = scores.where("key in ('a', 'b') and prob is not null and y is not null").withColumns(
        {"position": F.row_number().over(w.orderBy("prob", "y")), "n": F.count(F.lit(1)).over(w)})
    table = C.compare_calibrators(rows, ["key"], minimum=12).collect()
    assert sorted((r["key"], r["method"]) for r in table) == [(k, m) for k in "ab" for m in ("beta", "isotonic", "sigmoid")]
    for key in "ab":
        own = [r for r in table if r["key"] == key]
        assert sum(r["is_winner"] for r in own) == 1 and min(own, key=lambda r: (round(r["ece"], 9), r["method"]))["is_winner"]
