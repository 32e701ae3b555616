"""Exact nearest neighbours by cosine: a block matrix join on int8 codes with error bounds.

Candidates are dealt into shards by a hash of their id; every query goes to every shard, behind the shard's candidates. A
task holds one shard's candidates and lets the queries pass in blocks:

* Each unit vector x is coded as scale * int8 code; its error e(x) = |x - scale * code| is known. A tile of code products
  gives each cosine up to e(y) + e(x) * (1 + e(y)).
* A candidate whose upper bound is below the k-th largest lower bound of the query in this shard is out for certain.
* The surviving pairs are computed again from the original vectors in double precision, and a heap keeps the k best.

The k best of each shard are merged by rank. Products of codes are summed exactly (below 2**24 in float32 for up to 1000 dimensions, in
float64 beyond).

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component takes no part, as query or as
candidate; huge and tiny components are levelled by powers of two, so squares neither over- nor underflow; vectors of another
length than the query's are no candidates; rows with a null id take no part. Rows that share an id are one
item: it is never its own neighbour, and its best score counts. Ties go to the smaller id. A query without candidates has
no rows; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.llm.registry import query

TILE = 4 << 20  #: products in a tile


class Vectors:
    """A block of vectors of one length, with codes and bounds."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.raw = ids, raw
        self.norm = np.sqrt((raw * raw).sum(axis=1))
        unit = raw / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - codes * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12
        self.codes = codes
        self.wide = np.float32 if raw.shape[1] <= 1000 else np.float64


def usable(raw: np.ndarray) -> np.ndarray:
    return np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)


def levelled(raw: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1): the cosine stays the same to the last bit."""
    _, power = np.frexp(np.abs(raw).max(axis=1))
    return np.ldexp(raw, -power[:, None])


def blocks(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places in the batch and the vectors of the rows that can take part."""
    lists = batch.column(batch.schema.get_field_index("vec"))
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    out = {}
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        raw = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # a null component becomes NaN
        good = usable(raw)
        if good.any():
            out[size] = (at[good], levelled(raw[good]))
    return out


def tile(queries: Vectors, candidates: Vectors, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k best candidates of each query: ids of both and the score."""
    spare = len(candidates.ids) - len(np.unique(candidates.ids))  # further vectors of the same ids
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    step = max(1, TILE // len(candidates.ids))
    wide = candidates.codes.astype(candidates.wide).T
    for a in range(0, len(queries.ids), step):
        part = slice(a, a + step)
        close = (queries.codes[part].astype(queries.wide) @ wide).astype(np.float64)
        close *= queries.scale[part, None] * candidates.scale[None, :]
        bound = queries.error[part, None] + candidates.error[None, :] * (1 + queries.error[part, None])
        own = queries.ids[part, None] == candidates.ids[None, :]
        lower, upper = np.where(own, -np.inf, close - bound), np.where(own, -np.inf, close + bound)
        keep = min(k + spare, lower.shape[1])
        limit = np.partition(lower, -keep, axis=1)[:, -keep]
        left, right = np.nonzero((upper >= limit[:, None]) & ~own)
        score = np.empty(len(left))
        for b in range(0, len(left), 1 << 17):
            i, j = left[b : b + (1 << 17)] + a, right[b : b + (1 << 17)]
            score[b : b + (1 << 17)] = (queries.raw[i] * candidates.raw[j]).sum(axis=1) / (queries.norm[i] * candidates.norm[j])
        cuts = np.searchsorted(left, np.arange(lower.shape[0] + 1))
        for q in range(lower.shape[0]):
            best: dict[int, float] = {}
            for c, s in zip(candidates.ids[right[cuts[q] : cuts[q + 1]]].tolist(), score[cuts[q] : cuts[q + 1]].tolist()):
                best[c] = max(s, best.get(c, -2.0))
            for c, s in heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0])):
                out[0].append(int(queries.ids[a + q]))
                out[1].append(c)
                out[2].append(s)
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of every query row."""
    items = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("_query")).where("id is not null and vec is not null")
    shards = max(1, -(-items.count() // shard_rows))
    candidates = items.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("turn"))
    asked = items.where("_query").select("id", "vec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(1).alias("turn"))
    dealt = candidates.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "turn")

    def run(batches):
        shard, held, ready = None, {}, {}
        for batch in batches:
            where = batch.column(2).to_numpy(zero_copy_only=False)
            turn = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(turn) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if where[a] != shard:
                    shard, held, ready = where[a], {}, {}
                part = batch.slice(a, b - a)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for size, (at, raw) in blocks(part).items():
                    if turn[a] == 0:
                        held.setdefault(size, []).append((ids[at], raw))
                        continue
                    if size in held and size not in ready:
                        ready[size] = Vectors(*map(np.concatenate, zip(*held.pop(size))))
                    if size in ready:
                        q, c, s = tile(Vectors(ids[at], raw), ready[size], k)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    # an id with several vectors may come from several query rows
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_knn", SQL)
def op8(spark, folder):
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
