"""Window primitives. One partition = one (entity, series): its length is the number of periods.

Raw rows are always aggregated to periods before any of these run, so that a hot
entity never becomes a large window partition. Builders take a base spec
(partition + order) and add their own frame; Spark evaluates all frames over the
same spec in one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.scalars import ColumnLike, col, flag

TINY_STD = 1e-8


def by(*keys: str, order: str = "period_end") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def series_window(*extra: str) -> WindowSpec:
    return by(*extra, "entity_id", "series_id")


def trailing(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def expanding(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _guard(x: Column, frame: WindowSpec, minimum: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame) >= minimum, value)


def ffill(x: ColumnLike, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(expanding(w))


def pct_change(x: ColumnLike, k: int, w: WindowSpec, fill: str = "none") -> Column:
    """x / lag(x, k) - 1. ``fill='pad'`` carries the last value over gaps first; pass a padded column then."""
    if fill not in ("none", "pad"):
        raise ValueError(f"unknown fill {fill!r}")
    return F.try_divide(col(x), F.lag(col(x), k).over(w)) - 1.0


def diff(x: ColumnLike, k: int, w: WindowSpec) -> Column:
    return col(x) - F.lag(col(x), k).over(w)


def rolling_mean(x: ColumnLike, k: int, w: WindowSpec, minimum: int | None = None) -> Column:
    x, frame = col(x), trailing(w, k)
    return _guard(x, frame, minimum or k, F.avg(x).over(frame))


def rolling_std(x: ColumnLike, k: int, w: WindowSpec, minimum: int | None = None) -> Column:
    x, frame = col(x), trailing(w, k)
    return _guard(x, frame, minimum or k, F.stddev_samp(x).over(frame))


def rolling_min(x: ColumnLike, k: int, w: WindowSpec, minimum: int | None = None) -> Column:
    x, frame = col(x), trailing(w, k)
    return _guard(x, frame, minimum or k, F.min(x).over(frame))


def rolling_quantile(x: ColumnLike, q: float, k: int, w: WindowSpec, minimum: int) -> Column:
    x, frame = col(x), trailing(w, k)
    return _guard(x, frame, minimum, F.percentile(x, q).over(frame))


def expanding_mean(x: ColumnLike, w: WindowSpec, minimum: int) -> Column:
    x, frame = col(x), expanding(w)
    return _guard(x, frame, minimum, F.avg(x).over(frame))


def expanding_std(x: ColumnLike, w: WindowSpec, minimum: int) -> Column:
    x, frame = col(x), expanding(w)
    return _guard(x, frame, minimum, F.stddev_samp(x).over(frame))


def expanding_z(x: ColumnLike, w: WindowSpec, minimum: int) -> Column:
    """Standard score against the history so far; NULL while the spread is (near) zero."""
    x = col(x)
    std = expanding_std(x, w, minimum)
    return F.try_divide(x - expanding_mean(x, w, minimum), F.when(std > TINY_STD, std))


def expanding_quantile(x: ColumnLike, q: float, w: WindowSpec, minimum: int) -> Column:
    x, frame = col(x), expanding(w)
    return _guard(x, frame, minimum, F.percentile(x, q).over(frame))


def centred_mean(x: ColumnLike, half: int, w: WindowSpec) -> Column:
    return F.avg(col(x)).over(w.rowsBetween(-half, half))


def forward_max(x: ColumnLike, h: int, w: WindowSpec) -> Column:
    """Maximum over the next h rows; NULL on the last h rows of the partition."""
    frame = w.rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(frame) == h, F.max(col(x)).over(frame))


def tertile_state(x: ColumnLike, low: ColumnLike, high: ColumnLike, digits: int = 9) -> Column:
    """weak / neutral / strong. Strong is tested first, so it wins where both bands meet."""
    x, lo, hi = (F.round(col(c), digits) for c in (x, low, high))
    known = x.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.when(known, F.when(x >= hi, "strong").when(x <= lo, "weak").otherwise("neutral"))


def position(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def last_known(x: str, date: str = "period_end", upto: Column | None = None) -> Column:
    """Aggregate: the latest non-null value (at or before a date)."""
    keep = F.col(x).isNotNull()
    if upto is not None:
        keep = keep & (F.col(date) <= upto)
    return F.max_by(F.when(keep, F.col(x)), F.when(keep, F.col(date)))


def first_date_where(condition: Column, date: str = "period_end") -> Column:
    """Aggregate: the first date on which a condition holds."""
    return F.min(F.when(condition, F.col(date)))


def with_islands(df, state: Column, w: WindowSpec, name: str = "island"):
    """Number the runs of equal consecutive state values."""
    changed = df.withColumn("_state", state).withColumn(
        "_new", F.when(F.col("_state").eqNullSafe(F.lag("_state").over(w)), 0).otherwise(1)
    )
    return changed.withColumn(name, F.sum("_new").over(expanding(w)).cast("bigint")).drop("_new")


def run_length(condition: Column, w: WindowSpec, rn: str = "rn") -> Column:
    """Rows spent in a state so far, 0 outside it: distance to the last row outside the state.

    Needs the row position as a column ``rn``; that keeps it on the same partitioning
    and sort as every other window of the series.
    """
    last_outside = F.max(F.when(flag(condition) == 0.0, F.col(rn))).over(expanding(w))
    return (F.col(rn) - F.coalesce(last_outside, F.lit(0))).cast("bigint")
