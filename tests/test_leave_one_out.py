"""The leave-one-out table: rows with missing members and rows that come twice, and how often rows travel."""

import random

import pytest

import __spark_entry__ as entry
from tidegauge.operators import ensemble as E

MEMBERS = ["m1", "m2", "m3"]


def plain(rows):
    """The same table in Python; rows are (run, row, y, m1, m2, m3)."""
    out = {}
    for run in {r[0] for r in rows} - {None}:
        own = [list(r) for r in rows if r[0] == run]
        for k in range(3, 6):
            known = [r[k] for r in own if r[k] is not None]
            for r in own:
                r[k] = sum(known) / len(known) if r[k] is None else r[k]
        groups = {}
        for r in own:
            groups.setdefault((r[1], r[2]), []).append(r[3:])
        scores = {name: [] for name in ["all", *MEMBERS]}
        for (_, y), members in groups.items():
            total, k = sum(map(sum, members)), 3 * len(members)
            scores["all"].append((round(total / k, 12), y))
            for m in members:
                for name, p in zip(MEMBERS, m):
                    scores[name].append((round((total - p) / (k - 1), 12), y))
        brier = {n: sum((p - y) ** 2 for p, y in s) / len(s) for n, s in scores.items()}
        pairs = lambda s: [(p > q) + (p == q) / 2 for p, y in s if y for q, z in s if not z]
        auc = {n: sum(pairs(s)) / len(pairs(s)) for n, s in scores.items()}
        for n in MEMBERS:
            out[run, n] = (brier[n], brier[n] - brier["all"], auc[n], brier["all"], auc["all"])
    return out


def test_missing_members_and_rows_that_come_twice(spark):
    rng = random.Random(3)
    p = lambda: None if rng.random() < 0.1 else rng.randint(0, 20) / 20
    rows = [(rng.choice(["a", "b", None]), f"r{rng.randint(0, 60)}", float(rng.randint(0, 1)), p(), p(), p()) for _ in range(200)]
    df = spark.createDataFrame([*rows, *rows[:40]], "run_id string, row_id string, y double, m1 double, m2 double, m3 double")
    out = E.leave_one_out(df, ["run_id"], ["row_id"], MEMBERS).collect()
    expected = plain([*rows, *rows[:40]])
    assert len(out) == len(expected)
    for r in out:
        assert tuple(r)[2:] == pytest.approx(expected[r["run_id"], r["model"]], abs=1e-9)


def test_rows_are_read_and_sent_once(spark):
    out = entry.queries()["e16_leave_one_out"](spark, "/root/testdata/sf0.001")
    assert len(out.collect()) > 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("FileScan" in line and "lineitem.parquet" in line for line in plan.splitlines()) == 1 and "collect_list" not in plan
