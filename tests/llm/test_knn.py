import math

import numpy as np
import pytest
from brute import rows
from pyspark.sql import functions as F

import check
from tidegauge.llm import knn
from tidegauge.llm.queries import QUERIES, SQL
from tidegauge.llm.registry import importable


def brute(table, k, chosen):
    usable = [(i, v) for i, v in table if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    best = {}
    for q, v in usable:
        for c, w in usable:
            if chosen(q) and c != q and len(w) == len(v):
                a, b = np.array(v), np.array(w)
                own = best.setdefault(q, {})
                own[c] = max(own.get(c, -2), float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))))
    return sorted((q, r, c, s) for q, own in best.items() for r, (c, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k], 1))


def same(got, expect):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [e[:3] for e in expect]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expect], abs=1e-12)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op8_knn"](spark, folder).collect(), brute(rows(folder, "embeddings", "vec_id, embedding"), 5, lambda q: q % 50 == 0))
    assert check.compare(QUERIES["op8_knn"](spark, folder), check.connection(folder).sql(SQL["op8_knn"]), ties=True) == ""


def frame(spark, table):
    importable(spark)
    return spark.createDataFrame(table, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "vec", "shard", "turn", "score", "rank")})


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_ties_copies_and_unusable_vectors(spark, shard_rows):
    rng = np.random.default_rng(2)
    table = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]
    table += [(100 + i, [1.0, 2.0, 3.0]) for i in range(20)]
    table += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 0.0]), (204, [float("nan"), 1.0, 0.0]), (205, [float("inf"), 1.0, 0.0]), (206, [1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    same(knn.nearest(frame(spark, table), F.col("vec_id") % 3 == 0, 5, shard_rows=shard_rows).collect(), brute(table, 5, lambda q: q % 3 == 0))


def test_repeated_ids_and_few_candidates(spark):
    table = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    same(knn.nearest(frame(spark, table), F.lit(True), 2).collect(), brute(table, 2, lambda q: True))
    assert knn.nearest(frame(spark, [(1, [1.0])]), F.lit(True)).count() == 0
    assert knn.nearest(frame(spark, []), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(7)
    a, b = knn.Vectors(np.arange(50), rng.normal(size=(50, 64))), knn.Vectors(np.arange(80), rng.standard_t(2, size=(80, 64)))
    exact = (a.raw @ b.raw.T) / a.norm[:, None] / b.norm
    close = (a.codes.astype(float) @ b.codes.astype(float).T) * a.scale[:, None] * b.scale
    assert (np.abs(exact - close) <= a.error[:, None] + b.error * (1 + a.error[:, None])).all()


def test_huge_and_tiny_components(spark):
    """Squares that over- or underflow do not put a vector out; powers of two do not change a score."""
    table = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 0.0]), (3, [1e-200, 3e-200]), (4, [0.0, 5e-324]), (5, [2.0**500, 2.0**499]), (6, [2.0, 1.0]), (7, [0.0, 0.0])]
    got = sorted(map(tuple, knn.nearest(frame(spark, table), F.col("vec_id") == 0).collect()))
    ten, three, five = 1 / math.sqrt(1.01), 1 / math.sqrt(10), 2 / math.sqrt(5)
    assert [g[:3] for g in got] == [(0, 1, 2), (0, 2, 1), (0, 3, 5), (0, 4, 6), (0, 5, 3)]
    assert [g[3] for g in got] == pytest.approx([1.0, ten, five, five, three], abs=1e-12)
