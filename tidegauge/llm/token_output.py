"""Token ids in training order, as fixed-stride binary shards.

1. Texts are encoded by byte-level BPE, each followed by an end-of-text id, and laid end to end: rows in the order of their
   input split, splits in order. The stream is cut into sequences of ``length`` ids; the last one is filled up with the end id.
2. Sequence s of N goes to slot P(s), where P is a keyed permutation of 0 .. N-1: a balanced Feistel network over the smallest
   even number of bits that hold N, applied again as long as the result is N or more (cycle walking). No table of the
   permutation exists anywhere.
3. Slots are cut into ranges of ``shard_slots``; a shard's task sorts its pieces by slot and writes the file
   ``shard-<number>.bin``: little-endian uint16 ids (uint32 if the vocabulary is larger), ``length`` to a slot. Slot t is at byte
   (t mod shard_slots) * stride of shard t div shard_slots, so a reader can start or resume anywhere and read forward.

A file is written under a name of its attempt and then renamed, so a repeated task replaces it by the same bytes.

Defined results: a null or empty text is an end id alone; rows that repeat are encoded each; a null doc_id is recorded as
null; an empty table gives no slots and no files. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import RANKS, encode_text, encoding
from tidegauge.llm.common import mix, slices, table
from tidegauge.llm.registry import query
from tidegauge.session import durable, new_table_path

ROUNDS = 6
#: bytes of text whose ids are stored as one row; a longer text is a row of its own
SLICE = 1 << 17


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def network(v):
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = network(x.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = network(out[over])
    return out.astype(np.int64)


def encoded(docs: DataFrame, ranks: str, pattern: str, kind: str) -> DataFrame:
    """A row per slice of texts: part, start (ids before it in its part), n_ids, doc_ids and counts of its texts, ids (compressed)."""

    def run(batches):
        enc, pack, start, part = encoding(ranks, pattern), zstandard.ZstdCompressor(level=6), 0, TaskContext.get().partitionId()
        end = enc.n_vocab
        for batch in slices(batches, limit=SLICE):
            ids = [np.array([*encode_text(enc, text), end], kind) for text in batch.column(1).to_pylist()]
            counts = [len(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((part, pa.int64()), (start, pa.int64()), (sum(counts), pa.int64()), (batch.column(0).to_pylist(), pa.list_(pa.int64())),
                                               (counts, pa.list_(pa.int64())), (pack.compress(np.concatenate(ids).tobytes()), pa.binary()))],
                ["part", "start", "n_ids", "doc_ids", "counts", "ids"])
            start += sum(counts)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "part bigint, start bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, ids binary")


def common_ids(stored: DataFrame, pieces: int = 64, size: int = 2048) -> bytes:
    """The beginnings of some slices, which pieces are compressed against. They change the size of the shuffle, not the shards."""
    unpack = zstandard.ZstdDecompressor()
    return b"".join(unpack.decompress(r["ids"])[:size] for r in stored.select("ids").limit(pieces).collect())


def codec(shared: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(shared, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if shared else {}


def write_training_order(docs: DataFrame, folder: str, length: int = 1024, shard_slots: int = 4096, key: int = 2024, ranks: str = RANKS,
                         pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Write the shards and return one row per slot: slot, shard, byte_offset, n_ids, sha256 of its bytes, doc_ids."""
    n_vocab = encoding(ranks, pattern).n_vocab
    kind = "<u2" if n_vocab < 1 << 16 else "<u4"
    stored = durable(encoded(docs, ranks, pattern, kind))
    # one row per input split
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    firsts = durable(totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_first")))
    total = stored.agg(F.sum("n_ids")).first()[0] or 0
    n = -(-total // length)
    width = np.dtype(kind).itemsize

    shared = common_ids(stored)

    def cut(batches):
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3, **codec(shared))
        for batch in batches:
            for i in range(batch.num_rows):
                first, doc_ids, counts, packed = (c[i].as_py() for c in batch.columns)
                ids, ends = unpack.decompress(packed), np.cumsum(counts)
                sequences = np.arange(first // length, (first + ends[-1] - 1) // length + 1)
                starts = np.maximum(sequences * length - first, 0)
                stops = np.minimum((sequences + 1) * length - first, ends[-1])
                # the texts that a piece touches
                low, high = np.searchsorted(ends, starts, side="right"), np.searchsorted(ends, stops, side="left") + 1
                slots = permute(sequences, n, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots // shard_slots), pa.array(slots), pa.array((first + starts) % length, pa.int32()),
                     pa.array([list(dict.fromkeys(doc_ids[a:b])) for a, b in zip(low, high)], pa.list_(pa.int64())),
                     pa.array([pack.compress(ids[a * width : b * width]) for a, b in zip(starts, stops)], pa.binary())],
                    ["shard", "slot", "place", "doc_ids", "ids"])

    def write(batches):
        unpack = zstandard.ZstdDecompressor(**codec(shared))
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        file, name, shard, slot, parts, owners = None, None, None, None, [], []
        rows: list[tuple] = []

        def slot_done():
            raw = b"".join(parts)
            n_ids = len(raw) // width
            raw += np.full(length - n_ids, n_vocab, kind).tobytes()
            file.write(raw)
            rows.append((slot, shard, slot % shard_slots * length * width, n_ids, hashlib.sha256(raw).hexdigest(), list(dict.fromkeys(owners))))

        def file_done():
            file.close()
            store.move(name, f"{root}/{shard_name(shard)}")

        for batch in batches:
            for s, t, doc_ids, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if t != slot:
                    if slot is not None:
                        slot_done()
                    slot, parts, owners = t, [], []
                if s != shard:
                    if shard is not None:
                        file_done()
                    shard, name = s, f"{root}/.{shard_name(s)}.{uuid.uuid4().hex}"
                    file = store.open_output_stream(name)
                parts.append(unpack.decompress(packed))
                owners.extend(doc_ids)
            yield index_rows(rows)
            rows = []
        if slot is not None:
            slot_done()
            file_done()
        yield index_rows(rows)

    pieces = stored.join(firsts, "part").select((F.col("start") + F.col("_first")).alias("first"), "doc_ids", "counts", "ids").mapInArrow(
        cut, "shard bigint, slot bigint, place int, doc_ids array<bigint>, ids binary")
    shards = max(1, -(-n // shard_slots))
    dealt = pieces.repartition(max(1, min(shards, 100_000)), "shard").sortWithinPartitions("shard", "slot", "place")
    return durable(dealt.mapInArrow(write, "slot bigint, shard bigint, byte_offset bigint, n_ids int, sha256 string, doc_ids array<bigint>"))


def index_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["slot", "shard", "byte_offset", "n_ids", "sha256", "doc_ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names)


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def read_slots(folder: str, first: int, count: int, length: int = 1024, shard_slots: int = 4096, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of slots first, first + 1, ... read forward from the shards."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    stride, slot = length * np.dtype(kind).itemsize, first
    while slot < first + count:
        with store.open_input_file(f"{root}/{shard_name(slot // shard_slots)}") as file:
            stop = min(first + count, (slot // shard_slots + 1) * shard_slots)
            file.seek(slot % shard_slots * stride)
            for slot in range(slot, stop):
                yield np.frombuffer(file.read(stride), kind)
        slot = stop


def shared_path(spark: SparkSession, name: str) -> str:
    path = new_table_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@query("op6_token_output")
def op6(spark, folder):
    out = shared_path(spark, "training-order")
    return write_training_order(table(spark, folder, "documents"), out)
