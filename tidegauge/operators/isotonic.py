"""Isotonic maps for many keys at once.

Pool-adjacent-violators is mergeable: pooled blocks of neighbouring score ranges can be pooled again and give the blocks of
the whole. So scores are reduced to distinct ones with counts, pooled within score ranges in parallel, and the few remaining
blocks of a key are pooled once more. Both passes are streams over sorted rows that hold one stack of blocks.

A map is constant on a block, linear between blocks and constant beyond the first and the last. It is stored as intervals, cut
by a grid of scores, so that rows meet their interval by equality of key and grid cell and a check of its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.ordered import score_cells
from tidegauge.functions.scalars import clip

RANGES = 256  #: score ranges that are pooled apart
GRID = 256


def pool(stack: list[list], low: float, high: float, n: float, t: float) -> None:
    """Add a block of ``n`` rows, ``t`` of them positive, above all others; blocks that would fall are merged."""
    stack.append([low, high, n, t])
    while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
        _, high, n, t = stack.pop()
        stack[-1][1], stack[-1][2], stack[-1][3] = high, stack[-1][2] + n, stack[-1][3] + t


def _pooled(rows: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Rows (keys, within, low, high, n, t), pooled in the order of ``low`` for each of (keys, within)."""
    group = [*keys, *within]
    columns = [*group, "low", "high", "n", "t"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack = None, []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*now, *block) for block in stack], columns=columns)

        for pdf in batches:
            for row in pdf[columns].itertuples(index=False, name=None):
                key = row[: len(group)]
                if key != now:
                    if stack:
                        yield done()
                    now, stack = key, []
                pool(stack, *row[len(group) :])
        if stack:
            yield done()

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    return rows.select(*columns).repartition(*group).sortWithinPartitions(*group, "low").mapInPandas(run, names)


def blocks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, n, value): the fitted blocks of each key, from labelled scores (keys, prob, y)."""
    cells = score_cells(scores, keys).select(
        *keys, F.floor(F.col("prob") * RANGES).cast("bigint").alias("_range"), F.col("prob").alias("low"), F.col("prob").alias("high"),
        (F.col("tp") + F.col("fp")).cast("double").alias("n"), F.col("tp").cast("double").alias("t"))
    first = _pooled(cells, keys, ["_range"])
    return _pooled(first.drop("_range"), keys, []).select(*keys, "low", "high", "n", (F.col("t") / F.col("n")).alias("value"))


def intervals(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cell, x0, x1, v0, v1): the map as intervals [x0, x1), one row for each grid cell that an interval touches."""
    w = Window.partitionBy(*keys).orderBy("low")
    shaped = fitted.withColumns({"next_low": F.lead("low").over(w), "next_value": F.lead("value").over(w), "is_first": F.row_number().over(w) == 1})
    end, begin = F.lit(float("inf")), F.lit(float("-inf"))
    piece = lambda a, b, v, u: F.struct(a.alias("x0"), b.alias("x1"), v.alias("v0"), u.alias("v1"))
    v = F.col("value")
    parts = F.array(
        piece(F.when(F.col("is_first"), begin).otherwise(F.col("low")), F.col("high"), v, v),
        piece(F.col("high"), F.coalesce("next_low", end), v, F.coalesce("next_value", v)))
    cut = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * GRID)
    rows = shaped.select(*keys, F.inline(parts)).where("x0 < x1")
    return rows.withColumn("_cell", F.explode(F.sequence(cut(F.col("x0")), cut(F.col("x1")))))


def apply(scores: DataFrame, fitted: DataFrame, keys: list[str], name: str = "calibrated", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Scores in [0, 1] with their mapped value, clipped; a null score stays null, and scores of keys without a fit are clipped only."""
    mapped = intervals(fitted, keys).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    p = F.col("prob")
    cell = F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * GRID)
    on = (cell == F.col("_cell")) & (p >= F.col("x0")) & (p < F.col("x1"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    flat = (F.col("v0") == F.col("v1")) | F.col("x1").isin(float("inf"))
    value = F.when(flat, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (p - F.col("x0")) / (F.col("x1") - F.col("x0")))
    joined = scores.join(mapped, on, "left")
    return joined.withColumn(name, clip(F.coalesce(value, p), low, high)).select(*scores.columns, name)
