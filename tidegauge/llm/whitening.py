"""Whitening of embeddings; the covariance comes from variances alone, by polarisation.

1. An entry c becomes the integer x = floor(1024 c) + 100000, so that all sums are exact. n is the number of vectors and S_d
   the sum of dimension d; y_d = n x_d - S_d is the centred entry, scaled by n.
2. For every dimension and for the sum of every pair of dimensions the squares are added up:
   q_i = sum of y_i^2 and q_ij = sum of (y_i + y_j)^2, exact integers.
3. (q_ij - q_i - q_j) / 2 is the sum of y_i y_j: differences of variances give all cross-covariances. Divided by n^3 they are
   the covariances of x, assembled on the driver (dimensions squared, whatever the number of rows) for ``eigh``.
4. Rows are centred, projected on the components with the largest eigenvalues and divided by their roots. The covariance of
   the projected rows is measured on them and compared with the identity.

The table is read four times (its usual length, sums, squares, projection with its check); nothing is shuffled but one partial
result per partition, dimension and pair. Squares are added in 24-bit limbs, and beyond 44 bits as unbounded integers.
Partial sums travel in two decimals, exact up to 68 digits.

Defined results: vectors that are null, or hold null or non-finite entries, or entries whose x does not fit 62 bits, take no
part. Vectors belong to the most frequent length (the longer one of two); others cannot be projected and take no part. A
component without spread (eigenvalue below 1e-12 of the largest) cannot be scaled and is left out, so with fewer different
vectors than dimensions there are fewer components, and with one vector there are no rows. A deviation of more than 38 digits is
null. Rows that repeat count each; a null id stays null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.llm.registry import query

SCALE, SHIFT = 1024, 100_000
LIMB = 24  #: bits of a low limb
ROWS = 1 << 12  #: rows of a chunk, so that sums of limb products stay below 63 bits
SPLIT = 10**30  #: what a partial sum is divided by
SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray  #: the largest eigenvalues of the covariance of x, falling
    vectors: np.ndarray  #: one column for each of them
    trace: float


def usable(embeddings: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v): the vectors that take part, as doubles, but for their length."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= F.lit(2.0**62)))
    return embeddings.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)


def matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and x, in chunks of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
            yield part.column(0), np.floor(flat * SCALE).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, as 64-bit integers where they fit, else as unbounded ones."""
    most = max(1, int(np.abs(x).max(initial=0)))
    if most * n < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(y: np.ndarray, axis: int) -> np.ndarray:
    """Exact sums of squares along an axis of at most ``ROWS`` entries, as Python integers."""
    if y.dtype == object or int(np.abs(y).max(initial=0)) >= 1 << 44:
        return np.asarray((y.astype(object) ** 2).sum(axis=axis), object)
    high, low = y >> LIMB, y & ((1 << LIMB) - 1)
    limbs = [(high * high).sum(axis=axis), (high * low).sum(axis=axis), (low * low).sum(axis=axis)]
    return (limbs[0].astype(object) << (2 * LIMB)) + (limbs[1].astype(object) << (LIMB + 1)) + limbs[2].astype(object)


def totals(partial: DataFrame, keys: list[str]) -> dict[tuple, int]:
    summed = partial.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {tuple(r[k] for k in keys): int(r["high"]) * SPLIT + int(r["low"]) for r in summed.collect()}


def two_decimals(found: dict[tuple[int, int], int]) -> pa.RecordBatch:
    parts = [divmod(value, SPLIT) for value in found.values()]
    decimal = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()),
         pa.array([Decimal(h) for h, _ in parts], decimal), pa.array([Decimal(r) for _, r in parts], decimal)], ["i", "j", "high", "low"])


PARTIAL = "i int, j int, high decimal(38,0), low decimal(38,0)"


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of (vec_id, v), or None without vectors."""
    usual = vectors.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if usual is None:
        return None
    length, n = usual
    same = vectors.where(F.size("v") == length)

    def add_up(batches):
        found = {(d, d): 0 for d in range(length)}
        for _, x in matrices(batches, length):
            sums = x.sum(axis=0) if int(np.abs(x).max(initial=0)) < 1 << 50 else x.astype(object).sum(axis=0)
            for d in range(length):
                found[d, d] += int(sums[d])
        yield two_decimals(found)

    sums_of = totals(same.mapInArrow(add_up, PARTIAL), ["i", "j"])
    sums = tuple(sums_of[d, d] for d in range(length))

    def add_squares(batches):
        found = {(i, j): 0 for i in range(length) for j in range(i, length)}
        for _, x in matrices(batches, length):
            y = centred(x, n, sums)
            for i, q in enumerate(square_sums(y, 0)):
                found[i, i] += q
            for i in range(length - 1):
                for j, q in enumerate(square_sums(y[:, i : i + 1] + y[:, i + 1 :], 0), i + 1):
                    found[i, j] += q
        yield two_decimals({k: int(q) for k, q in found.items()})

    q = totals(same.mapInArrow(add_squares, PARTIAL), ["i", "j"])
    covariance = np.zeros((length, length))
    for (i, j), value in q.items():
        cross = value if i == j else (value - q[i, i] - q[j, j]) // 2
        covariance[i, j] = covariance[j, i] = cross / n**3
    values, axes = np.linalg.eigh(covariance) if length else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1], axes[:, ::-1]
    spread = int((values > 1e-12 * max(values.max(initial=0.0), 1e-300)).sum())
    keep = min(components, spread)
    return Whitening(n, sums, values[:keep].copy(), axes[:, :keep].copy(), float(np.trace(covariance)))


def project(y: np.ndarray, model: Whitening) -> np.ndarray:
    return (y / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the projected rows' covariance minus the identity."""
    length, k = len(model.sums), len(model.values)

    def moments(batches):
        for _, x in matrices(batches, length):
            z = project(centred(x, model.n, model.sums), model)
            mean = z.mean(axis=0)
            second = (z - mean).T @ (z - mean) + len(z) * np.outer(mean, mean)
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(second.reshape(-1)), pa.array(len(z) * mean[i])], ["i", "j", "second", "first"])

    got = vectors.where(F.size("v") == length).mapInArrow(moments, "i int, j int, second double, first double").groupBy("i", "j").agg(F.sum("second").alias("second"), F.sum("first").alias("first"))
    rows = {(r["i"], r["j"]): r for r in got.collect()}  # components squared
    covariance = np.array([[rows[i, j]["second"] / model.n - rows[i, i]["first"] * rows[j, j]["first"] / model.n**2 for j in range(k)] for i in range(k)])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: its whitened value, with the measures of the fit beside it."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings, key, column)
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    length, k = len(model.sums), len(model.values)
    error = identity_error(vectors, model)
    explained = model.values / model.trace

    def run(batches):
        for ids, x in matrices(batches, length):
            y = centred(x, model.n, model.sums)
            deviation = pa.array([Decimal(d) if abs(d) < 10**38 else None for d in square_sums(y, 1).tolist()], pa.decimal128(38, 0))
            rows = len(ids)
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviation.take(at),
                 pa.array(project(y, model).reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(F.size("v") == length).mapInArrow(run, SCHEMA)


@query("op12_whitening")
def op12(spark, folder):
    out = whiten(table(spark, folder, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
