"""Helpers shared by the operators: Arrow text access, word hashing on whole batches, two-level running sums."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import durable

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPARK_WORD = r"[^\x20\x09-\x0D]+"

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the byte offset of every row (null counts as empty)."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of text, or one longer row. No row is cut."""
    for batch in batches:
        _, offsets = text_bytes(batch, name)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _UNBASE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which ``range_hashes`` takes the hash of any range."""
    power, _ = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return total


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_sums(data), starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` neighbouring words and the row of each, rows ascending, positions ascending.

    A row with fewer words, but at least one, has its whole word sequence as a single shingle.
    """
    count = np.diff(first)
    per_row = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), per_row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[row]
    value = np.zeros(len(row), np.uint64)
    stop = first[row + 1] if len(row) else at
    for k in range(width):
        here = np.minimum(at + k, max(len(hashes) - 1, 0))
        value = np.where(at + k < stop, mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[here] + np.uint64(k + 1)), value)
    return value, row


def distinct_sorted(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order; ``row`` ascends."""
    value = value.copy()
    cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def repeated(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have a twin (an equal value in the same row)."""
    own = mix(value + row.astype(np.uint64) * np.uint64(_BASE))
    ordered = np.sort(own)
    twins = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twins):
        return np.zeros(len(value), bool)
    at = np.minimum(np.searchsorted(twins, own), len(twins) - 1)
    return twins[at] == own


def running(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str = "rank") -> DataFrame:
    """Add the 1-based ``rank`` of each row in a total order and, for ``sums`` (new name: column), the sum up to the row.

    Rows are cut into ranges of the order; sums run within a range and over the totals of the ranges, of which
    there are as many as shuffle partitions. So no task sees all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(df.repartitionByRange(parts, *order).withColumn("_run_part", F.spark_partition_id()))
    totals = cut.groupBy("_run_part").agg(F.count(F.lit(1)).alias("_run_n"), *[F.sum(c).alias(f"_run_t_{name}") for name, c in sums.items()])
    before = Window.orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_run_part", F.coalesce(F.sum("_run_n").over(before), F.lit(0)).alias("_run_n"),
        *[F.coalesce(F.sum(f"_run_t_{name}").over(before), F.lit(0)).alias(f"_run_t_{name}") for name in sums])
    within = Window.partitionBy("_run_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", F.row_number().over(within).alias("_run_r"), *[F.sum(c).over(upto).alias(f"_run_s_{name}") for name, c in sums.items()])
    out = out.join(offsets, "_run_part")
    return out.select(
        *df.columns, (F.col("_run_r") + F.col("_run_n")).alias(rank), *[(F.col(f"_run_s_{name}") + F.col(f"_run_t_{name}")).alias(name) for name in sums])
