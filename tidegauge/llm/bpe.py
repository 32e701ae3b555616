"""Byte-level BPE: encode whole texts with the tiktoken library and a local rank file, decode ids to raw bytes.

A long text is first cut at safe boundaries: before a space that stands between two letters or digits. No match of the
splitting pattern crosses such a place (a match that starts with the space takes the following word; a match that ends
there cannot take the space), so the pieces encode to the same ids as the whole. A text without such a place stays whole.

Defined results: a null or empty text has no ids; rows keep their order and repeat if they repeat; a null doc_id stays null;
an empty table gives an empty table; other columns are never read, so clashing names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import slices, table
from tidegauge.llm.registry import query

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = 1 << 15
SAFE = re.compile(r"(?<=[^\W_])(?= [^\W_])")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in order, cut at safe boundaries about every ``long`` characters."""
    start = 0
    while len(text) - start > long and (cut := SAFE.search(text, start + long)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None, long: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text, long):
        out += enc.encode_ordinary(piece)
    return out


OUTPUTS = {
    "ids": ("ids array<int>", pa.list_(pa.int32())),
    "decoded": ("decoded binary", pa.binary()),
    "n_tokens": ("n_tokens bigint", pa.int64()),
    "ids_sha256": ("ids_sha256 string", pa.string()),
    "decoded_sha256": ("decoded_sha256 string", pa.string()),
}


def encode_decode(docs: DataFrame, outputs: tuple[str, ...] = ("ids", "decoded"), ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN,
                  long: int = LONG) -> DataFrame:
    """doc_id and the asked outputs of each row: ids, bytes decoded from the ids, and digests of both."""

    def run(batches):
        enc = encoding(ranks, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)] if "ids_sha256" in outputs else []
        for batch in slices(batches):
            got: dict[str, list] = {name: [] for name in outputs}
            for text in batch.column(1).to_pylist():
                ids = encode_text(enc, text, long)
                if "ids" in got:
                    got["ids"].append(ids)
                if "n_tokens" in got:
                    got["n_tokens"].append(len(ids))
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                if "decoded" in got or "decoded_sha256" in got:
                    raw = enc.decode_bytes(ids)
                    if "decoded" in got:
                        got["decoded"].append(raw)
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[name], OUTPUTS[name][1]) for name in outputs]], ["doc_id", *outputs])

    schema = ", ".join(["doc_id bigint", *[OUTPUTS[name][0] for name in outputs]])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


@query("op10_bpe")
def op10(spark, folder):
    return encode_decode(table(spark, folder, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))
