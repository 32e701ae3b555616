"""Token counts of whole texts, as the tokenizers library gives them.

Why counts add up at white space: the tokenizer's normalizer neither composes nor reorders characters across a space, it maps
every run of white space to a space, and no match of its word pattern and no special token holds white space. So a place
after ASCII white space is a stable boundary: the tokens on either side do not depend on the other side.

* Ordinary texts are cut at ASCII white space; each distinct word of a batch is encoded once.
* Huge texts are encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced at a stable boundary in
  their overlap at which both have a token starting, with the same tokens after it. If the overlap has none, it is widened
  until it has one, at worst to the whole text. A chunk may start in the middle of a word: nothing before the splice is
  taken from it.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows repeat if they repeat; a null doc_id stays null; an
empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm.common import slices, table
from tidegauge.llm.registry import query

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
HUGE, CHUNK, OVERLAP, AGREE = 1 << 16, 1 << 14, 256, 4
#: Words remembered by a Python worker before it starts anew.
REMEMBERED = 300_000
SPACE = " \t\n\v\f\r"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Span:
    """Tokens of text[begin:end] with their places in the whole text."""

    def __init__(self, tok: Tokenizer, text: str, begin: int, end: int):
        got = tok.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end = begin, end
        self.ids = np.array(got.ids, np.int64)
        self.starts = np.array([a for a, _ in got.offsets], np.int64) + begin

    def cut(self, place: int) -> None:
        keep = self.starts >= place
        self.begin, self.ids, self.starts = place, self.ids[keep], self.starts[keep]


def splice(text: str, left: Span, right: Span, agree: int = AGREE) -> int | None:
    """A stable boundary at which both spans start a token and have the same tokens from there on."""
    for i in np.flatnonzero((left.starts > right.begin) & (left.starts < left.end)):
        place = int(left.starts[i])
        if text[place - 1] not in SPACE:
            continue
        j = int(np.searchsorted(right.starts, place))
        n = min(agree, len(left.ids) - i, len(right.ids) - j)
        # the last tokens of the left span may belong to a word that goes on after it
        whole = n == agree or left.end == len(text)
        if whole and n and np.array_equal(left.starts[i : i + n], right.starts[j : j + n]) and np.array_equal(left.ids[i : i + n], right.ids[j : j + n]):
            return place
    return None


def count_huge(tok: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    total, size = 0, len(text)
    left = Span(tok, text, 0, min(size, chunk + overlap))
    while left.end < size:
        width = overlap
        while True:
            begin = left.end - width
            if begin <= left.begin:  # the overlap has grown over the whole span: go on with a longer one
                left = Span(tok, text, left.begin, min(size, left.end + max(chunk, left.end - left.begin)))
                break
            right = Span(tok, text, begin, min(size, begin + width + chunk))
            place = splice(text, left, right)
            if place is not None:
                total += int((left.starts < place).sum())
                right.cut(place)
                left = right
                break
            width *= 2
    return total + len(left.ids)


def count_tokens(docs: DataFrame, limit: int = 2048, path: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def run(batches):
        tok, seen = tokenizer(path), {}
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            n_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            counts = np.zeros(len(texts), np.int64)
            large = n_chars > huge
            if large.any():
                for i in np.flatnonzero(large):
                    counts[i] = count_huge(tok, texts[int(i)].as_py(), chunk, overlap)
            rest = pc.if_else(pa.array(large), pa.scalar("", pa.large_string()), texts)
            split = pc.ascii_split_whitespace(rest)
            coded = split.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [w for w in distinct if w not in seen]
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = distinct
            seen.update(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False))))
            per_word = np.array([seen[w] for w in distinct] or [0], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(per_word)])
            offsets = split.offsets.to_numpy()
            counts += np.diff(sums[offsets - offsets[0]])
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


@query("op4_token_counts")
def op4(spark, folder):
    return count_tokens(table(spark, folder, "documents"))
