"""Alignment of raw observations to a month-end panel, and what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import month_end, shift_months

KEYS = ["entity_id", "series_id"]


def month_end_last(obs: DataFrame, keys: list[str] = KEYS, date: str = "obs_date", value: str = "value") -> DataFrame:
    """Last non-null observation of each month. Partial aggregation happens before the shuffle."""
    known = F.col(value).isNotNull()
    return (
        obs.groupBy(*keys, month_end(date).alias("period_end"))
        .agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(date))).alias("value"))
    )


def dense_calendar(monthly: DataFrame, entity: str = "entity_id", series: str = "series_id") -> DataFrame:
    """One row per (entity, series, month) between the entity's first and last month.

    Every row stretches over the gap that follows it (and the first one over the gap
    before it), so the calendar needs no join. Both windows and everything that is
    windowed by series afterwards share one partitioning by entity.
    """
    per_entity = Window.partitionBy(entity)
    w = W.by(entity, series)
    step = F.expr("interval 1 month")
    month = F.trunc("period_end", "month")
    framed = monthly.select(entity, series, "period_end", "value").withColumns({
        "_lo": F.min(month).over(per_entity), "_hi": F.max(month).over(per_entity),
        "_first": F.row_number().over(w) == 1, "_next": F.lead(month).over(w),
    })
    start = F.when(F.col("_first"), F.col("_lo")).otherwise(month)
    end = F.coalesce(F.add_months("_next", -1), F.col("_hi"))
    spread = framed.select(entity, series, F.col("period_end").alias("_own"), "value", F.explode(F.sequence(start, end, step)).alias("_m"))
    at = F.last_day("_m")
    return spread.select(entity, series, at.alias("period_end"), F.when(at == F.col("_own"), F.col("value")).alias("value"))


def interpolate_quarterly(
    panel: DataFrame, method: str = "linear", gate: bool = True, keys: list[str] = KEYS, quarterly_only: str | None = None,
) -> DataFrame:
    """Fill months between quarterly readings, only for series less than half observed.

    ``linear`` uses the next reading (as the monthly history is stored today);
    ``ffill`` only what was known at each month. Leading gaps stay NULL, the tail
    repeats the last reading. ``quarterly_only`` names a boolean column that restricts
    the fill to marked series (and is dropped).
    """
    w = W.by(*keys)
    everything, past, future = W.whole(w), W.expanding(w), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("value")
    df = panel.withColumn("_i", F.row_number().over(w))
    at = F.when(v.isNotNull(), F.col("_i"))
    df = (
        df.withColumn("_n", F.count("value").over(everything)).withColumn("_rows", F.count(F.lit(1)).over(everything))
        .withColumn("_lo", F.last("value", True).over(past)).withColumn("_il", F.last(at, True).over(past))
        .withColumn("_hi", F.first("value", True).over(future)).withColumn("_ih", F.first(at, True).over(future))
    )
    step = F.try_divide(
        (F.col("_hi") - F.col("_lo")) * (F.col("_i") - F.col("_il")), (F.col("_ih") - F.col("_il")).cast("double")
    )
    filled = F.col("_lo") if method == "ffill" else F.coalesce(F.col("_lo") + step, F.col("_lo"))
    sparse = (F.col("_n") > 0) & (F.col("_n") < F.col("_rows") * 0.5) if gate else F.lit(True)
    if quarterly_only:
        sparse = sparse & F.col(quarterly_only)
    out = F.when(v.isNotNull() | ~sparse, v).otherwise(filled)
    return df.withColumn("value", out).drop("_i", "_n", "_rows", "_lo", "_il", "_hi", "_ih", *([quarterly_only] if quarterly_only else []))


def forward_fill(panel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return panel.withColumn("value", W.ffill("value", W.by(*keys)))


def fill_zero(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.coalesce("value", F.lit(0.0)))


def fill_mean(panel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return panel.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy(*keys))))


def reindex(calendar: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    return calendar.join(series, keys, "left")


def pivot_wide(panel: DataFrame, names: list[str], keys: list[str] = ["entity_id", "period_end"]) -> DataFrame:
    """Long to wide with named columns. Conditional aggregates, unlike a pivot, let unused columns be pruned."""
    wanted = panel.where(F.col("series_id").isin(list(names)))
    return wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("series_id") == n, F.col("value"))).alias(n) for n in names])


def unpivot_long(wide: DataFrame, names: list[str], keys: list[str] = ["entity_id", "period_end"], label: str = "feature") -> DataFrame:
    return wide.unpivot(keys, names, label, "value")


def as_of(panel: DataFrame, origins: DataFrame, date: str = "period_end") -> DataFrame:
    """Rows known at each origin (date at or before it). Origins are a handful of rows from a spec."""
    return panel.join(origins.select("origin"), F.col(date) <= F.col("origin"))


def lag_mask(
    frame: DataFrame, lags: DataFrame, keys: list[str] = KEYS, default_lag: int = 1,
    mode: str = "tail", label_series: str = "RECESSION",
) -> DataFrame:
    """Hide what was not yet published.

    ``tail``: the last ``lag`` rows of every series become NULL.
    ``shift``: every row shows the value that was published by then.
    The label series is never masked.
    """
    w = W.by(*keys)
    known = frame.join(lags.select("series_id", "lag_months"), "series_id", "left")
    lag = F.when(F.col("series_id") == label_series, 0).otherwise(F.coalesce("lag_months", F.lit(default_lag)))
    known = known.withColumn("_lag", lag)
    if mode == "shift":
        # any lag at all: the value of the row that stands ``lag`` rows earlier in the series
        placed = known.withColumn("_at", F.row_number().over(w) - F.col("_lag"))
        source = frame.select(*keys, F.row_number().over(w).alias("_at"), F.col("value").alias("_earlier"))
        return placed.join(source, [*keys, "_at"], "left").withColumn("value", F.col("_earlier")).select(*known.columns).drop("lag_months", "_lag")
    newest_first = Window.partitionBy(*keys).orderBy(F.col("period_end").desc())
    return (
        known.withColumn("_r", F.row_number().over(newest_first))
        .withColumn("value", F.when(F.col("_r") > F.col("_lag"), F.col("value")))
        .drop("lag_months", "_lag", "_r")
    )


def known_vintage(vintages: DataFrame, origins: DataFrame) -> DataFrame:
    """The value of every observation as it was known at each origin (bitemporal as-of join)."""
    o = origins.select("origin")
    live = (F.col("realtime_start") <= F.col("origin")) & (
        F.col("realtime_end").isNull() | (F.col("origin") < F.col("realtime_end"))
    )
    monthly = vintages.join(o, live & (F.col("obs_date") <= F.col("origin")))
    known = F.col("value").isNotNull()
    return monthly.groupBy("origin", *KEYS, month_end("obs_date").alias("period_end")).agg(
        F.max_by(F.when(known, F.col("value")), F.when(known, F.col("obs_date"))).alias("vintage_value")
    )


def substitute_vintages(masked: DataFrame, trimmed: DataFrame, vintages: DataFrame, core: list[str]) -> DataFrame:
    """Core series take their vintage where one exists at all for that origin; the rest stay lag-masked."""
    keys = ["origin", *KEYS]
    joined = masked.join(vintages, [*keys, "period_end"], "left")
    any_vintage = F.max(F.col("vintage_value").isNotNull()).over(Window.partitionBy(*keys))
    use = F.col("series_id").isin(core) & any_vintage
    return joined.withColumn("value", F.when(use, F.col("vintage_value")).otherwise(F.col("value"))).drop("vintage_value")


def vintage_coverage_status(frame: DataFrame, vintages: DataFrame, core: list[str]) -> DataFrame:
    """Status per (origin, entity, core series): was a vintage there, and did it align?"""
    keys = ["origin", *KEYS]
    have = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frame"))
    raw = vintages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"), F.count("vintage_value").alias("n_values"))
    names = F.explode(F.array(*[F.lit(c) for c in core])).alias("series_id")
    wanted = frame.select("origin", "entity_id").distinct().select("origin", "entity_id", names)
    status = (
        F.when(F.col("n_frame").isNull(), "missing_in_frame")
        .when(F.col("n_raw").isNull(), "alfred_unavailable")
        .when(F.col("n_values") > 0, "alfred_ok")
        .otherwise("alfred_empty_after_align")
    )
    return wanted.join(have, keys, "left").join(raw, keys, "left").select(*keys, status.alias("status"))


def month_range(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), F.last_day)


def parse_dates(df: DataFrame, text: str, name: str) -> DataFrame:
    """Coerce to dates and drop rows without one."""
    return df.withColumn(name, F.to_date(F.try_to_timestamp(F.col(text)))).where(F.col(name).isNotNull())


def months_before(d: Column | str, months: int) -> Column:
    return shift_months(d, -months)
