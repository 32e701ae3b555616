"""Each stage against a plain version on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from brute import WORD, mixing_targets, near_dup, quality_base, secrets_base

from tidegauge.llm import bpe, secret_scan
from tidegauge.llm.common import table
from tidegauge.session import durable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    out = [table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], FOLDER)))
        if name != "encoding":
            assert out[-1].columns == corpus_pipeline.COLUMNS
    return [[r.asDict() for r in df.collect()] for df in out]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]


def test_quality(kept):
    before, after = kept[0], kept[1]
    ids = {r["doc_id"] for r in after}
    assert all(r in before for r in after) and len(after) < len(before)
    for r in before:
        n_words, _, _, _, n_repeat = quality_base(r["text"])
        if n_words < 10 or 100 * n_repeat > 20 * n_words:
            assert r["doc_id"] not in ids


def test_near_duplicates(kept):
    groups = near_dup([(r["doc_id"], r["text"]) for r in kept[1]], 5, 80)
    assert {r["doc_id"] for r in kept[2]} == {d for d, _, _, stays in groups if stays}


def test_secrets(kept):
    assert len(kept[3]) == len(kept[2])
    old = {r["doc_id"]: r["text"] for r in kept[2]}
    for r in kept[3]:
        assert secrets_base(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"])
        assert (r["text"] != old[r["doc_id"]]) == any(rule for rule in secret_scan.RULES if secret_scan.spans_of(rule, __import__("re").compile(rule.pattern), old[r["doc_id"]]))


def test_mixing(kept):
    sizes, taken = Counter(), Counter()
    for r in kept[3]:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in kept[4]:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for source, target in mixing_targets(sizes).items():
        assert abs(taken[source] - float(target)) <= 0.02 * float(target) + 2


def test_encoding(kept):
    enc = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in kept[5]) == Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in kept[4])


def test_run_gives_the_rows_of_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter(r["ids_sha256"] for r in got.collect()) == Counter(r["ids_sha256"] for r in kept[5])
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept[5])


def test_odd_documents(docs):
    rows = [(1, None), (2, ""), (3, "a few words"), (3, "a few words"), (None, "one two three four five six seven eight nine ten eleven"), (4, "x" * 100_000)]
    from pyspark.sql import SparkSession

    for rows_ in (rows, []):
        frame = docs(rows_)
        for _, stage in corpus_pipeline.STAGES:
            frame = durable(stage(SparkSession.active(), frame, FOLDER))
        assert {r["doc_id"] for r in frame.collect()} <= {None, 1, 2, 3, 4}
