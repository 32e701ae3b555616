import random

import numpy as np
import pytest
from brute import near_dup, rows, shingle_set

from tidegauge.llm import minhash
from tidegauge.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_all_pairs(spark, folder):
    assert got(QUERIES["op7_minhash"](spark, folder)) == sorted(near_dup(rows(folder, "documents", "doc_id, text")), key=repr)


def variants(seed: int, families: int, size: int, change: float):
    """Families of texts at all distances around the limit, chains included."""
    rng, out = random.Random(seed), []
    for f in range(families):
        text = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 12, 40, 160]))]
        for _ in range(size):
            if rng.random() < 0.6:
                text = [w if rng.random() > change else f"x{rng.randint(0, 10**6)}" for w in text]
            out.append(" ".join(text))
    order = list(range(len(out)))
    rng.shuffle(order)
    return list(zip(order, out))


@pytest.mark.parametrize("seed,change,width,percent", [(1, 0.01, 3, 85), (2, 0.02, 3, 85), (3, 0.004, 5, 80)])
def test_links_near_the_limit(docs, seed, change, width, percent):
    table = variants(seed, 25, 14, change)
    assert got(minhash.near_duplicates(docs(table), width, percent)) == sorted(near_dup(table, width, percent), key=repr)


def test_odd_tables(docs):
    table = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c"), (8, "A b\tC"), (9, "a b c d"), (9, "a b c d"), (20, "É b c"), (21, "é b c")]
    assert got(minhash.near_duplicates(docs(table))) == sorted(near_dup(table), key=repr)
    unnamed = got(minhash.near_duplicates(docs([(None, "a b c"), (None, "a b c"), (3, "a b c")])))
    assert unnamed == [(3, 1, 3, True), (None, 1, None, True), (None, 1, None, True)]
    assert minhash.near_duplicates(docs([])).count() == 0 and minhash.deduplicate(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    long = "w " * 0 + " ".join(f"w{i}" for i in range(300))
    frame = docs([(5, long), (2, long + " x"), (9, long), (7, "other text"), (7, "other text"), (None, long), (8, None)])
    kept = minhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 2), (False, 7), (False, 8), (True, None)]


def test_sketch_is_a_function_of_the_set_and_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
    value, row = minhash.distinct_sorted(np.concatenate([a, b, a[::-1]]), np.repeat([0, 1, 2], 400))
    cells = minhash.sketch(value, row, 3, 1024)
    assert (cells[0] == cells[2]).all()
    assert abs((cells[0] == cells[1]).mean() - 360 / 440) < 0.05
    tiny, _ = minhash.distinct_sorted(a[:6], np.zeros(6, int))
    assert set(minhash.sketch(tiny, np.zeros(6, int), 1, 96)[0]) <= set(a[:6])


def test_shingles_match_plain_sets(spark, docs):
    table = variants(9, 6, 3, 0.1) + [(1000 + i, t) for i, t in enumerate(["a", "a b", "a b c", "A B c", None, "x  y\nz\tq"])]
    signed = {r["doc_id"]: (r["n_shingles"], r["k1"], r["k2"]) for r in minhash.signatures(docs(table), 3, 85).collect()}
    sets = {d: shingle_set(t) for d, t in table}
    assert all(signed[d][0] == len(sets[d]) for d in sets)
    for d in sets:
        for e in sets:
            assert (signed[d] == signed[e]) == (sets[d] == sets[e])
