"""Cumulative sums and exact quantiles over probability scores, without one task per group.

Scores are first reduced to distinct values per key (map-side combine). Running totals
then work on two levels: within a narrow score bucket, and over bucket subtotals. The
buckets are a fixed function of the score, so every stage agrees on them after a retry,
and a key that holds a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 65536


def score_cells(scores: DataFrame, keys: list[str], prob: str = "prob", y: str = "y", count: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; ``count`` names a column with the number of rows that a row stands for."""
    n = F.col(count) if count else F.lit(1)
    return scores.where(F.col(prob).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(prob).alias("prob")).agg(
        F.sum(F.when(F.col(y) == 1.0, n).otherwise(0)).alias("tp"), F.sum(F.when(F.col(y) == 1.0, 0).otherwise(n)).alias("fp"))


def cumulate(cells: DataFrame, keys: list[str], measures: list[str], value: str = "prob", descending: bool = True) -> DataFrame:
    """Add ``c_<m>`` (running total including the row) and ``t_<m>`` (total of the key)."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    bucket_order = F.col("_b").desc() if descending else F.col("_b").asc()
    cells = cells.withColumn("_b", F.floor(F.col(value) * GRID))
    within = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
        .select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
                *[F.sum(f"_s_{m}").over(per_key).alias(f"t_{m}") for m in measures])
    )
    local = cells.select("*", *[F.sum(m).over(within).alias(f"_w_{m}") for m in measures])
    out = local.join(offsets, [*keys, "_b"])
    for m in measures:
        out = out.withColumn(f"c_{m}", F.col(f"_w_{m}") + F.col(f"_o_{m}"))
    return out.drop("_b", *[f"_w_{m}" for m in measures], *[f"_o_{m}" for m in measures])


def cumulate_small(cells: DataFrame, keys: list[str], measures: list[str], value: str = "prob", descending: bool = True) -> DataFrame:
    """Same columns where every key is known to be short (a rolling window of months)."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("*", *[F.sum(m).over(run).alias(f"c_{m}") for m in measures],
                        *[F.sum(m).over(w).alias(f"t_{m}") for m in measures])


def exact_quantiles(cells: DataFrame, keys: list[str], probs: list[float], count: str = "n", value: str = "prob") -> DataFrame:
    """Linearly interpolated quantiles per key, as the array ``q``, from value counts."""
    ranked = cumulate(cells, keys, [count], value, descending=False)
    c, t = F.col(f"c_{count}"), F.col(f"t_{count}")

    def holds(rank: Column) -> Column:
        return F.when((rank < c) & (rank >= c - F.col(count)), F.col(value))

    at = lambda p: (t - 1).cast("double") * F.lit(p)
    picks = []
    for i, p in enumerate(probs):
        picks += [F.max(holds(F.floor(at(p)))).alias(f"lo{i}"), F.max(holds(F.ceil(at(p)))).alias(f"hi{i}")]
    edges = ranked.groupBy(*keys).agg(F.max(f"t_{count}").alias("_t"), *picks)
    pos = lambda p: (F.col("_t") - 1).cast("double") * F.lit(p)
    mix = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (pos(p) - F.floor(pos(p))) for i, p in enumerate(probs)]
    return edges.select(*keys, F.array(*mix).alias("q"))
