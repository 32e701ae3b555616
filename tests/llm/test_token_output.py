from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from brute import rows, sha

from tidegauge.llm import bpe, token_output
from tidegauge.llm.common import table
from tidegauge.llm.registry import importable


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 99):
        assert sorted(token_output.permute(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 100:
        p = token_output.permute(np.arange(n), n, 7)
        assert (p != token_output.permute(np.arange(n), n, 8)).any() and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.2


def stream(table_):
    """Ids in the order of the rows, each text with an end."""
    enc = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    return [[*enc.encode_ordinary(t or ""), enc.n_vocab] for _, t in table_]


def check(frame, table_, folder, length, shard_slots):
    index = token_output.write_training_order(frame, f"file://{folder}", length, shard_slots).collect()
    total = sum(map(len, stream(table_)))
    n = -(-total // length)
    assert sorted(r["slot"] for r in index) == list(range(n))
    got = list(token_output.read_slots(f"file://{folder}", 0, n, length, shard_slots))
    for r in index:
        assert sha(got[r["slot"]].tobytes()) == r["sha256"] and r["shard"] == r["slot"] // shard_slots
        raw = (Path(folder) / token_output.shard_name(r["shard"])).read_bytes()
        assert raw[r["byte_offset"] : r["byte_offset"] + 2 * length] == got[r["slot"]].tobytes()
    again = np.concatenate([got[s] for s in token_output.permute(np.arange(n), n, 2024)]) if n else np.zeros(0, int)
    end = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN).n_vocab
    assert (again[total:] == end).all() and sum(r["n_ids"] for r in index) == total
    texts = np.split(again[:total], np.flatnonzero(again[:total] == end) + 1)[:-1]
    assert sorted(map(tuple, texts)) == sorted(map(tuple, stream(table_)))
    for k in range(3):  # resume in the middle
        assert [x.tolist() for x in token_output.read_slots(f"file://{folder}", n // 3 + k, min(5, n - n // 3 - k), length, shard_slots)] == [x.tolist() for x in got[n // 3 + k :][:5]]
    assert not [f for f in Path(folder).glob(".*") if f.suffix != ".crc"]
    return index


def test_whole_table(spark, tmp_path):
    importable(spark)
    folder = "/root/testdata/sf0.001"
    table_ = rows(folder, "documents", "doc_id, text")
    index = check(table(spark, folder, "documents"), table_, tmp_path, 256, 100)
    assert {d for r in index for d in r["doc_ids"]} == {d for d, _ in table_}


def test_odd_tables(docs, tmp_path):
    odd = [(1, None), (2, ""), (2, ""), (None, "some text"), (3, "word " * 20_000), (4, "x")]
    check(docs(odd), odd, tmp_path / "a", 16, 8)
    check(docs([]), [], tmp_path / "b", 16, 8)
    check(docs([(1, None)]), [(1, None)], tmp_path / "c", 16, 8)
