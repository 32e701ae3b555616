import random

import numpy as np
import pytest
from brute import near_dup, rows
from test_minhash import variants

from tidegauge.llm import jaccard_join as jj
from tidegauge.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_shingles", "component_id")


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def want(table, width=5, percent=80):
    return sorted((r[:3] for r in near_dup(table, width, percent)), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_all_pairs(spark, folder):
    assert got(QUERIES["op11_jaccard_join"](spark, folder)) == want(rows(folder, "documents", "doc_id, text"))


@pytest.mark.parametrize("seed,change,width,percent", [(1, 0.008, 5, 80), (2, 0.02, 3, 85), (3, 0.03, 2, 60)])
def test_links_near_the_limit(docs, seed, change, width, percent):
    table = variants(seed, 25, 14, change)
    assert got(jj.jaccard_join(docs(table), width, percent)) == want(table, width, percent)


def test_odd_tables(docs):
    table = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (8, "A b\tC d e"), (9, "a b c d e f"), (9, "a b c d e f"), (20, "É b c d e"), (21, "é b c d e")]
    assert got(jj.jaccard_join(docs(table))) == want(table)
    unnamed = got(jj.jaccard_join(docs([(None, "a b c"), (None, "a b c"), (3, "a b c")])))
    assert unnamed == [(3, 1, 3), (None, 1, None), (None, 1, None)]
    assert jj.jaccard_join(docs([])).count() == 0


def test_very_long_text(docs):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    edited = [w if rng.random() > 0.02 else f"x{i}" for i, w in enumerate(long)]
    table = [(1, "short text of a few words only"), (2, " ".join(long)), (3, " ".join(edited)), (4, " ".join(reversed(long)))]
    assert got(jj.jaccard_join(docs(table))) == want(table)


def test_cells_meet_for_every_linked_pair():
    """Small sets share a cell whenever they reach the limit, exactly; points never bound a pair below its overlap."""
    rng = np.random.default_rng(7)
    for percent in (60, 80, 85):
        levels = jj.Levels.up_to(percent)
        met = 0
        for _ in range(400):
            a = rng.integers(0, 1 << 62, rng.integers(2, 90), dtype=np.uint64)
            gone, new = rng.integers(0, max(1, len(a) // 4)), rng.integers(0, max(1, len(a) // 4))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 62, new, dtype=np.uint64)])
            common = len(a) - gone
            if 100 * common < percent * (len(a) + new) or len(a) + new == common:
                continue
            value, row = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
            key_row, key, point_row, point_level, points = jj.cells_and_points(value, row, 2, levels)
            assert set(key[key_row == 0]) & set(key[key_row == 1]), (percent, len(a), gone, new)
            at = [{int(v): np.frombuffer(points[i], np.uint8) for i, v in enumerate(point_level) if point_row[i] == r} for r in (0, 1)]
            for level in set(at[0]) & set(at[1]):
                p, q = at[0][level], at[1][level]
                assert np.minimum(p, q).sum() >= common and jj.may_link(p, p, q, q, percent)
            met += 1
        assert met > 50


def test_large_sets_meet_almost_surely():
    rng = np.random.default_rng(9)
    levels, shared = jj.Levels.up_to(80), []
    for _ in range(60):
        size = int(rng.integers(200, 6000))
        a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        b = np.concatenate([a[size // 9 :], rng.integers(0, 1 << 62, size // 9, dtype=np.uint64)])
        value, row = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
        key_row, key, *_ = jj.cells_and_points(value, row, 2, levels)
        shared.append(len(set(key[key_row == 0]) & set(key[key_row == 1])))
        assert len(key) < 250
    assert np.mean(shared) > 20 and min(shared) > 5


def hot(seed: int) -> list[tuple]:
    """Texts that share a passage and fall into many components, with chains that the first probes do not join."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(700):
        own = [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(18, 60))]
        out.append(passage + own)
    for _ in range(60):
        chain = passage + [f"c{rng.randint(0, 10**6)}" for _ in range(40)]
        for _ in range(6):
            chain = [w if rng.random() > 0.02 else f"y{rng.randint(0, 10**6)}" for w in chain]
            out.append(list(chain))
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_trees_of_many_leaves(docs, monkeypatch):
    table = hot(3)
    frame = docs(table)
    assert got(jj.jaccard_join(frame)) == want(table)
    calls = []
    real = jj.descend
    monkeypatch.setattr(jj, "LEAF", 1 << 11)
    monkeypatch.setattr(jj, "FAN", 4)
    monkeypatch.setattr(jj, "descend", lambda leaves, percent: calls.append(leaves) or real(leaves, percent))
    assert got(jj.jaccard_join(frame)) == want(table)
    assert calls


def test_boxes_prune_and_keep(spark):
    a, b = np.array([3, 0, 5, 2], np.uint8), np.array([0, 4, 1, 5], np.uint8)
    assert not jj.may_link(a, a, b, b, 80) and jj.may_link(a, a, a, a, 100)
    assert jj.may_link(np.minimum(a, b), np.maximum(a, b), b, b, 80)


def test_leaf_comparison_gives_chains_not_all_pairs():
    shingles = np.arange(100)
    rows = [{"node": i, "n": 100, "label": i, "open": True, "counts": b"", "shingles": np.concatenate([shingles[1:], [1000 + i]])} for i in range(50)]
    assert len(list(jj.compare(rows, None, 80))) == 49
    assert len(list(jj.compare(rows[:25], rows[25:], 80))) == 49
