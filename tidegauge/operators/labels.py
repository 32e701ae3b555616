"""Forward labels, chronological splits, folds, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import half_life, shift_months


def forward_label(flags: DataFrame, horizon: int, keys: tuple[str, ...] = ("entity_id",), name: str = "y") -> DataFrame:
    """1.0 when the event occurs within the next ``horizon`` months; NULL on the last ``horizon`` rows."""
    return flags.withColumn(name, W.forward_max("flag", horizon, W.by(*keys)))


def multi_horizon(flags: DataFrame, horizons: tuple[int, ...] = (3, 6, 12, 18), keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    w = W.by(*keys)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("y")) for h in horizons])
    wide = flags.withColumns({f"_h{h}": W.forward_max("flag", h, w) for h in horizons})
    return wide.select(*keys, "period_end", F.inline(pairs))


def numbered(rows: DataFrame, keys: list[str], order: str = "period_end") -> DataFrame:
    """Row position and row count per key, both from one partitioning."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(order)), "n": F.count(F.lit(1)).over(w)})


def chronological_split(labelled: DataFrame, share: float = 0.8, cut: Column | None = None, keys: list[str] = ["entity_id"]) -> DataFrame:
    if cut is not None:
        return labelled.withColumn("role", F.when(F.col("period_end") <= cut, "train").otherwise("test"))
    df = numbered(labelled, keys)
    return df.withColumn("role", F.when(F.col("rn") <= F.floor(F.col("n") * share), "train").otherwise("test")).drop("rn", "n")


def time_folds(labelled: DataFrame, splits: int = 5, keys: list[str] = ["entity_id"]) -> DataFrame:
    """Expanding folds: each row appears in its own test fold and in the training part of later folds."""
    df = numbered(labelled, keys)
    size = F.floor(F.col("n") / (splits + 1))
    start = lambda i: F.col("n") - size * (splits - i)
    roles = [
        F.struct(F.lit(i).alias("fold"),
                 F.when(F.col("rn") <= start(i), "train").when(F.col("rn") <= start(i) + size, "test").alias("role"))
        for i in range(splits)
    ]
    return df.select(*labelled.columns, F.inline(F.array(*roles))).where("role is not null")


def knowable(frame: DataFrame, horizon: int) -> DataFrame:
    """Rows whose label was already observable at the forecast origin."""
    return frame.where((F.col("period_end") <= shift_months("origin", -horizon)) & F.col("y").isNotNull())


def origin_admissibility(frame: DataFrame, horizon: int, min_train: int = 180, keys: list[str] = ["origin", "entity_id"]) -> DataFrame:
    """Train size, classes and prediction row per origin, with the reason an origin is skipped."""
    train = (F.col("period_end") <= shift_months("origin", -horizon)) & F.col("y").isNotNull()
    at_origin = F.col("period_end") == F.col("origin")
    stats = frame.groupBy(*keys).agg(
        F.count_if(train).alias("train_rows"), F.sum(F.when(train, F.col("y")).otherwise(0.0)).cast("bigint").alias("train_positives"),
        F.count_if(at_origin).alias("n_at_origin"), F.count_if(at_origin & F.col("y").isNotNull()).alias("n_labelled"))
    reason = (
        F.when(F.col("train_rows") < min_train, "insufficient_history")
        .when((F.col("train_positives") == 0) | (F.col("train_positives") == F.col("train_rows")), "one_class")
        .when(F.col("n_at_origin") == 0, "origin_missing")
        .when(F.col("n_labelled") == 0, "label_unavailable")
    )
    return stats.select(*keys, shift_months("origin", -horizon).alias("label_cutoff"), "train_rows", "train_positives", reason.alias("reason"))


def class_weights(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Balanced class weights n / (2 n_class) and the negative-to-positive ratio, from one aggregate per key.

    The aggregate is joined back, so that a large group is never held by one window task.
    """
    stats = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_p"))
    own = F.when(F.col("y") == 1.0, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return labelled.join(stats, keys).withColumns({
        "weight": F.try_divide(F.col("_n").cast("double"), 2.0 * own),
        "scale_pos": F.try_divide(F.col("_n") - F.col("_p"), F.col("_p")),
    }).drop("_n", "_p")


def recency_weights(rows: DataFrame, months: float, floor: float = 0.25, keys: list[str] = ["entity_id"]) -> DataFrame:
    df = numbered(rows, keys)
    aged = df.withColumn("_w", F.greatest(half_life((F.col("n") - F.col("rn")).cast("double"), months), F.lit(floor)))
    return aged.withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(*keys))).drop("_w", "rn", "n")


def look_back(rows: DataFrame, columns: list[str], length: int = 6, keys: list[str] = ["entity_id"]) -> DataFrame:
    """The previous ``length`` rows as a list; rows without a full list are dropped."""
    past = F.collect_list(F.struct(*columns)).over(W.by(*keys).rowsBetween(-length, -1))
    return rows.withColumn("sequence", past).where(F.size("sequence") == length)
