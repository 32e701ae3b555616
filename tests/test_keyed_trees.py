"""Keyed forests against a brute-force split search and their invariants."""

import numpy as np
import pytest

from tidegauge.operators import keyed_trees as T

WIDTH = 4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    out = []
    for key, size in (("a", 220), ("b", 60)):
        x = rng.integers(0, 9, size=(size, WIDTH)).astype(float)
        y = ((x[:, 0] > 4) ^ (x[:, 2] > 6) ^ (rng.random(size) < 0.1)).astype(float)
        out += [(key, i, [float(v) for v in r], float(t), float(1 + i % 3)) for i, (r, t) in enumerate(zip(x, y))]
    return out


@pytest.fixture(scope="module")
def rows(spark, data):
    odd = [("one", i, [float(i)] * WIDTH, 1.0, 1.0) for i in range(30)] + [("a", 900, [1.0] * WIDTH, None, 1.0), ("none", 1, [1.0] * WIDTH, None, 1.0)]
    return spark.createDataFrame([*data, *odd], "key string, id bigint, x array<double>, y double, wt double")


def brute(x, y, w, node, depth, least, out):
    """Every split of every node, tried on the rows themselves."""
    gini = lambda k: 0.0 if not k.any() else 2 * w[k & (y > 0)].sum() * w[k & (y < 1)].sum() / w[k].sum()
    every = np.ones(len(y), bool)
    best = (0.0, 0, 0, None)
    for f in range(WIDTH):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) >= least:
                gain = round(gini(every) - gini(left) - gini(~left), 9)
                if gain > best[0]:
                    best = (gain, f, v, left)
    out[node] = (best[1] if best[3] is not None else -1, best[0], (w * y).sum() / w.sum())
    if best[3] is not None and depth > 1:
        for child, k in ((2 * node, best[3]), (2 * node + 1, ~best[3])):
            brute(x[k], y[k], w[k], child, depth - 1, least, out)


def test_one_tree_is_the_brute_force_tree(rows, data):
    """Small parts, so that histograms of a node come from several tasks."""
    forest, _ = T.fit(rows, ["key"], WIDTH, ["id"], trees=1, depth=4, least=5, bins=32, tries=WIDTH, weight="wt", bootstrap=False, part_rows=50)
    got = {(r["key"], r["node"]): (r["feature"], r["gain"], r["p"]) for r in forest.collect()}
    for key in "ab":
        x, y, w = (np.array([r[c] for r in data if r[0] == key]) for c in (2, 3, 4))
        expect = {}
        brute(x, y, w, 1, 4, 5, expect)
        mine = {n: v for (k, n), v in got.items() if k == key}
        assert set(mine) == set(expect)
        for n, (f, gain, p) in expect.items():
            assert mine[n][0] == f and mine[n][1] == pytest.approx(gain, abs=1e-8) and mine[n][2] == pytest.approx(p)


def test_forest(rows, data):
    keep = dict(trees=40, depth=5, least=3, weight="wt")
    forest, cuts = T.fit(rows, ["key"], WIDTH, ["id"], part_rows=70, **keep)
    whole, _ = T.fit(rows, ["key"], WIDTH, ["id"], **keep)
    kept = lambda f: sorted((r["key"], r["tree"], r["node"], r["feature"], r["bin"]) for r in f.collect())
    assert kept(forest) == kept(whole)  # the parts do not matter
    got = T.score(rows, forest, cuts, ["key"], ["id"], depth=5).collect()
    assert len(got) == rows.count()
    fits = [r for r in got if r["key"] in "ab" and r["y"] is not None]
    assert all(0 <= r["prob"] <= 1 for r in fits)
    assert np.mean([(r["prob"] >= 0.5) == (r["y"] == 1) for r in fits]) > 0.8
    assert {r["prob"] for r in got if r["key"] == "one"} == {1.0}  # one class: bare roots
    assert [r["prob"] for r in got if r["key"] == "none"] == [None]
    shares = {(r["key"], r["feature"]): r["importance"] for r in T.importance(forest, ["key"]).collect()}
    assert sum(v for (k, _), v in shares.items() if k == "a") == pytest.approx(1.0)
    assert min(shares["a", 0], shares["a", 2]) > max(shares["a", 1], shares["a", 3])
