"""Column expressions with one null rule each: NULL in, NULL out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1.0 where true, 0.0 where false *or unknown*."""
    return F.when(condition, 1.0).otherwise(0.0)


def clip(x: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Clip on one or both sides. A bare least/greatest would turn NULL into the bound."""
    x = col(x)
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(x.isNotNull(), out)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def safe_ratio(a: ColumnLike, b: ColumnLike, tiny: float = 1e-12) -> Column:
    """a / b, NULL where the denominator is within ``tiny`` of zero."""
    b = col(b)
    return F.try_divide(col(a), F.when(F.abs(b) > tiny, b))


def all_flags(*flags: Column) -> Column:
    return reduce(lambda a, b: a * b, flags)


def at_least(k: int, *flags: Column) -> Column:
    return flag(reduce(lambda a, b: a + b, flags) >= k)


def row_mean(*columns: ColumnLike) -> Column:
    """Mean across columns, skipping NULLs."""
    cols = [col(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, F.nullif(count, F.lit(0)).cast("double"))


def logit(p: ColumnLike, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def half_life(age: Column, months: float) -> Column:
    return F.pow(F.lit(0.5), age / float(months))


def risk_band(p: ColumnLike) -> Column:
    p = col(p)
    return (
        F.when(p.isNull(), None).when(p < 0.15, "LOW").when(p < 0.35, "MODERATE").when(p < 0.60, "ELEVATED").otherwise("HIGH")
    )


def relative_signal(p: ColumnLike, threshold: ColumnLike) -> Column:
    """Signal strength relative to the run's own decision threshold."""
    p, t = col(p), col(threshold)
    return (
        F.when(p.isNull() | t.isNull(), None)
        .when(p < 0.3 * t, "LOW").when(p < 0.7 * t, "MODERATE").when(p < t, "ELEVATED").otherwise("HIGH")
    )


def month_end(d: ColumnLike) -> Column:
    return F.last_day(F.to_date(col(d)))


def shift_months(d: ColumnLike, months: int | Column) -> Column:
    """Month arithmetic that always lands on a month end."""
    return F.last_day(F.add_months(col(d), months))


def month_key(d: ColumnLike) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def parse_bool(s: ColumnLike) -> Column:
    return col(s).try_cast("boolean")


def parse_fraction(s: ColumnLike) -> tuple[Column, Column]:
    """Both counts of a text such as ``5/6``."""
    parts = F.split(col(s), "/")
    return F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
