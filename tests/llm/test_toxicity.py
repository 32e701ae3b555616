import zlib

import numpy as np
import pytest
from brute import rows

from tidegauge.llm import toxicity
from tidegauge.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, folder).collect()}
    assert len(got) == len(rows(folder, "documents", "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in got.items())
    held = [(got[d], toxic) for d, toxic in rows(folder, "labels", "doc_id, toxic") if got[d]["held_out"]]
    bad = [r["predicted"] for r, toxic in held if toxic == 1]
    good = [r["predicted"] for r, toxic in held if toxic == 0]
    assert np.mean(bad) > 0.85 and np.mean(good) < 0.02


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, toxic int")


def test_only_the_text_counts_and_held_out_labels_are_not_used(spark, docs):
    table = [(i, f"words {i} and {'zorgle you' if i % 2 else 'plain talk'} here", "en", "s") for i in range(200)]
    truth = [(i, i % 2) for i in range(200)]
    flipped = [(i, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in truth]
    scores = []
    for some in (truth, flipped):
        frame = docs(table)
        out = toxicity.score(frame, toxicity.fit(frame, labels(spark, some))).collect()
        scores.append({r["doc_id"]: round(r["score"], 9) for r in out})
    assert scores[0] == scores[1]
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores[0].items())
    other = docs([(5000 + i, t, "fr", "q") for i, t, *_ in table])
    again = {r["doc_id"] - 5000: round(r["score"], 9) for r in toxicity.score(other, toxicity.fit(docs(table), labels(spark, truth))).collect()}
    assert again == scores[0]


def test_odd_tables(spark, docs):
    frame = docs([(1, None), (2, ""), (None, "you idiot"), (3, "hello"), (3, "hello"), (4, "idiot " * 50_000)])
    for some in ([], [(3, 0)], [(None, 1), (3, None), (4, 1), (4, 0), (77, 1)]):
        got = {(r["doc_id"], r["held_out"]): r for r in toxicity.score(frame, toxicity.fit(frame, labels(spark, some))).collect()}
        assert got[(None, False)]["held_out"] is False and {k[0] for k in got} == {1, 2, 3, 4, None}
    assert toxicity.score(docs([]), toxicity.fit(docs([]), labels(spark, []))).count() == 0


@pytest.mark.parametrize("clause,mode", [
    ("what an idiot", toxicity.PLAIN), ("you are an idiot", toxicity.TARGETED), ("he is not an idiot", toxicity.NEGATED), ("she said what an idiot", toxicity.REPORTED),
    ('the word “idiot', toxicity.REPORTED), ("not at all a real idiot", toxicity.PLAIN)])
def test_modes(clause, mode):
    sums, threats, met = toxicity.Grammar().clause(toxicity.TOKEN.findall(clause))
    assert [k for k, s in enumerate(sums) if s] == [mode] and threats == 0 and met == {"idiot"}


def test_threats_need_announcement_harm_and_target():
    grammar = toxicity.Grammar()
    threat = lambda c: grammar.clause(c.split())[1]
    assert threat("we will hurt you") == 1 and threat("we hurt you") == 0 and threat("we will hurt it") == 0


def test_longest_beginning_wins():
    grammar = toxicity.Grammar({"abcdefgh": 1.0}, {"abcd": 2.0, "abcdef": 3.0})
    assert [grammar.weight(w) for w in ("abcdefgh", "abcdefx", "abcdx", "abcd", "xabcd")] == [1.0, 3.0, 2.0, 0.0, 0.0]
