import math
from decimal import Decimal

import numpy as np
import pytest
from brute import rows

from tidegauge.llm import whitening
from tidegauge.llm.queries import QUERIES
from tidegauge.llm.registry import importable


def plain(vectors: list[tuple]) -> dict:
    """vec_id -> (n, deviation, whitened values), with unbounded integers and cross products."""
    used = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, size = len(used), len(used[0][1])
    sums = [sum(x[d] for _, x in used) for d in range(size)]
    y = [[n * x[d] - sums[d] for d in range(size)] for _, x in used]
    cross = np.array(y, object).T @ np.array(y, object)
    covariance = np.array([[cross[i, j] / n**3 for j in range(size)] for i in range(size)])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    z = np.array([[v / n for v in r] for r in y]) @ axes / np.sqrt(values)
    return {i: (n, sum(v * v for v in r), z[k], values / np.trace(covariance)) for k, ((i, _), r) in enumerate(zip(used, y))}


def check(got, want):
    by_row: dict = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_row) == set(want)
    signs: dict = {}
    for i, (n, deviation, z, explained) in want.items():
        assert sorted(by_row[i]) == list(range(1, len(z) + 1))
        for c, r in by_row[i].items():
            assert r["n"] == n and r["deviation"] == deviation
            if c not in signs and abs(z[c - 1]) > 1e-3:
                signs[c] = 1 if z[c - 1] * r["whitened"] > 0 else -1
            assert abs(abs(r["whitened"]) - abs(z[c - 1])) < 1e-6 and (abs(z[c - 1]) < 1e-3 or signs[c] * z[c - 1] * r["whitened"] > 0)
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8


def test_query_matches_cross_products(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op12_whitening"](spark, folder)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), plain(rows(folder, "embeddings", "vec_id, embedding")))


def frame(spark, vectors):
    importable(spark)
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    return df.selectExpr("*", "'x' AS n", "1 AS v", "2 AS component", "'y' AS i", "0 AS high")


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(40, good_row := [1e6, -2.5, 0.0, 3.0, 1e-9]), (41, good_row)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan, 0.0, 0.0, 0.0, 0.0]), (103, [0.0, math.inf, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1e300, 0.0, 0.0, 0.0, 0.0])]
    check(whitening.whiten(frame(spark, good + bad)).collect(), plain(good))


def test_no_spread_and_empty_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [])])).collect() == []
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (None, [3.0, 2.0, 0.0])])).collect()
    assert sorted((r["component"], r["vec_id"] is None, r["vec_id"]) for r in two) == [(1, False, 1), (1, False, 2), (1, True, None)]
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("size", [1 << 20, 1 << 43, 1 << 50])
def test_squares_are_exact(size):
    y = np.random.default_rng(1).integers(-size, size, (300, 7))
    assert [int(v) for v in whitening.square_sums(y, 0)] == [sum(int(v) ** 2 for v in y[:, d]) for d in range(7)]
    assert [int(v) for v in whitening.square_sums(y, 1)] == [sum(int(v) ** 2 for v in r) for r in y]
    wide = whitening.centred(y, 10**6, tuple(int(v) for v in y.sum(axis=0)))
    assert int(wide[5, 2]) == int(y[5, 2]) * 10**6 - int(y[:, 2].sum())


def test_large_entries_stay_exact(spark):
    vectors = [(i, [2.0**46 * (i % 3), float(i)]) for i in range(9)]
    got = whitening.whiten(frame(spark, vectors)).where("component = 1").collect()
    want = plain(vectors)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: Decimal(w[1]) for i, w in want.items()}
