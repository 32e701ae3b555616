import random
from collections import Counter, defaultdict

import pytest
from brute import WORD, mixing_targets, rows, sainte_lague
from pyspark.sql import functions as F

from tidegauge.llm import mixing
from tidegauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def check(out, table):
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, text, source in table:
        sizes[source] += size_of(text)
    targets = mixing_targets(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in out) == sorted((d is None, d, size_of(t)) for d, t, _ in table)
    taken = defaultdict(int)
    source = {d: s for d, _, s in table}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(targets[s]), rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - float(targets[s])) <= 0.02 * float(targets[s]) + 2


def test_query(spark):
    table = rows(FOLDER, "documents", "doc_id, text, source")
    once = QUERIES["op3_mixing"](spark, FOLDER).collect()
    check(once, table)
    assert sorted(once) == sorted(QUERIES["op3_mixing"](spark, FOLDER).collect())


def test_odd_tables(docs):
    table = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "q " * 50, None), (5, "w " * 500, "y"), (6, "one two", "z"), (7, "  ", "empty"), (8, "a b c", "x")]
    check(mixing.plan(docs([(d, t, "en", s) for d, t, s in table])).collect(), table)
    assert mixing.plan(docs([])).count() == 0
    assert mixing.plan(docs([(1, None, "en", None)])).collect()[0]["taken"] == 0


def test_hot_source_in_many_shards(docs):
    rng = random.Random(5)
    table = [(i, "w " * rng.randint(0, 80), rng.choice(["hot"] * 8 + ["a", "b", "c", None])) for i in range(400)]
    check(mixing.plan(docs([(d, t, "en", s) for d, t, s in table]), shard_docs=16).collect(), table)


def test_apportionment_matches_highest_quotients(spark):
    rng = random.Random(3)
    cases = [([rng.choice([0.0, rng.random() * 10 ** rng.randint(0, 4)]) for _ in range(rng.randint(1, 12))], rng.randint(0, 60)) for _ in range(40)]
    data = [(g, i, v, seats) for g, (votes, seats) in enumerate(cases) for i, v in enumerate(votes)]
    frame = spark.createDataFrame(data, "g int, i int, v double, s bigint")
    got = defaultdict(dict)
    for r in mixing.apportion(frame, F.col("s"), ["g"], [F.col("i")], "v", "won").collect():
        got[r["g"]][r["i"]] = r["won"]
    for g, (votes, seats) in enumerate(cases):
        assert [got[g][i] for i in range(len(votes))] == sainte_lague(votes, seats), (votes, seats)


def test_taken_rows_hold_the_planned_words(docs):
    table = [(i, " ".join(f"w{i}_{k}" for k in range(1 + 7 * (i % 5))), "en", "abc"[i % 3] if i % 7 else None) for i in range(60)] + [(61, None), (62, "")]
    frame = docs(table)
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(frame).collect()}
    mix = mixing.take(frame)
    assert mix.columns == frame.columns and mix.dtypes == frame.dtypes
    words = Counter()
    for r in mix.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(WORD.findall(r["text"])) <= set(WORD.findall(table[r["doc_id"]][1]))
    assert words == Counter({d: n for d, n in plan.items() if n})
    assert mixing.take(docs([])).count() == 0


def test_repeated_rows_and_clashing_names(docs):
    """Rows that share doc_id, source and size each get one of their plans, whatever the other columns are called."""
    table = [(7, f"a{i % 3} b c", "en", "hot") for i in range(40)] + [(None, "x y", "en", None)] * 9 + [(i, "w " * (5 + i), "en", "s") for i in range(20, 50)]
    frame = docs(table).selectExpr("*", *[f"'{n}' AS {n}" for n in ("passes", "from1", "to1", "from2", "to2", "_copy", "_d", "_row", "_plan", "taken", "_again_d")])
    plan = Counter()
    for r in mixing.plan(frame).collect():
        plan[r["doc_id"]] += r["taken"]
    got, mix = Counter(), mixing.take(frame)
    assert mix.dtypes == frame.dtypes
    for r in mix.collect():
        assert r["passes"] == "passes" and r["_plan"] == "_plan"
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == Counter({d: n for d, n in plan.items() if n})


def test_a_small_source_leaves_the_blocks_of_others_alone(docs):
    """Large sources get whole blocks of 64 words beside a source of a few words, and every source comes near its target."""
    table = [(i, "w " * 100, "en", "ab"[i % 2]) for i in range(600)] + [(1000, "one two three", "en", "c"), (1001, "x " * 90, "en", None)]
    out = mixing.plan(docs(table)).collect()
    check(out, [(d, t, s) for d, t, _, s in table])
    taken = Counter()
    for r in out:
        taken["c" if r["doc_id"] == 1000 else "null" if r["doc_id"] == 1001 else "ab"[r["doc_id"] % 2]] += r["taken"]
    assert taken["a"] % 64 == 0 and taken["b"] % 64 == 0
    assert taken["c"] == 9  # three times its size, to the word
