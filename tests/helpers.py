"""Small panels for unit tests."""

from __future__ import annotations

import datetime as dt

import numpy as np

from tidegauge.sources.catalog import dimension


def months(n: int, start=(1990, 1)) -> list[dt.date]:
    out = []
    for i in range(n):
        y, m = start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1
        out.append(dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1))
    return out


def panel(spark, series: dict[str, list], entity: str = "A"):
    rows = [
        (entity, name, d, None if v is None or (isinstance(v, float) and np.isnan(v)) else float(v))
        for name, values in series.items()
        for d, v in zip(months(len(values)), values)
    ]
    return dimension(spark, rows, "entity_id STRING, series_id STRING, period_end DATE, value DOUBLE")


def column(df, name: str, *order: str) -> list:
    return [r[name] for r in df.orderBy(*(order or ("period_end",))).collect()]
