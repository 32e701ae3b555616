"""Shared common table expressions of the SQL oracles (DuckDB dialect).

They restate :mod:`tidegauge.sources.driver_panel` over the same parquet tables.
"""

from __future__ import annotations

import re

from tidegauge.sources import catalog
from tidegauge.sources.driver_panel import PRIORITIES, SERIES5, proxies


def over(frame: str = "", keys: str = "entity_id, series_id", order: str = "period_end") -> str:
    return f"(PARTITION BY {keys} ORDER BY {order} {frame})"


def trail(k: int, keys: str = "entity_id, series_id", order: str = "period_end") -> str:
    return over(f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW", keys, order)


def upto(keys: str = "entity_id, series_id", order: str = "period_end") -> str:
    return over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", keys, order)


def ahead(h: int, keys: str = "entity_id, series_id", order: str = "period_end") -> str:
    return over(f"ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING", keys, order)


def guarded(fn: str, x: str, frame: str, minimum: int) -> str:
    return f"CASE WHEN COUNT({x}) OVER {frame} >= {minimum} THEN {fn} OVER {frame} END"


def zscore(x: str, frame: str, minimum: int) -> str:
    std = f"STDDEV_SAMP({x}) OVER {frame}"
    return (
        f"CASE WHEN COUNT({x}) OVER {frame} >= {minimum} AND {std} > 1e-8 "
        f"THEN ({x} - AVG({x}) OVER {frame}) / ({std}) END"
    )


def pct(x: str, k: int, w: str) -> str:
    return f"({x} / NULLIF(LAG({x}, {k}) OVER {w}, 0) - 1.0)"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        text = str(v).replace("'", "''")
        return f"DATE '{text}'" if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else f"'{text}'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def _count(cond: str) -> str:
    return f"SUM(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _measures(date: str, name: str) -> str:
    extra = ", ".join(f"{_count(f'o_orderpriority = {p!r}')} AS n{i}" for i, p in enumerate(PRIORITIES, 1))
    extra += ", " + ", ".join(f"{_count(f'o_orderstatus = {s!r}')} AS n{s.lower()}" for s in "FOP")
    return (
        f"SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, {date} AS {name}, SUM(1.0::DOUBLE) AS n, "
        f"CAST(SUM(c) AS DOUBLE) AS cents, CAST(MAX(c) AS DOUBLE) AS hi, CAST(MIN(c) AS DOUBLE) AS lo, {extra} "
        "FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders) "
        "JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
    )


def _series(base: str, date: str, series: dict[str, str]) -> str:
    wide = ", ".join(f'({e}) AS "{k}"' for k, e in series.items())
    names = ", ".join(f'"{k}"' for k in series)
    return (
        f"SELECT entity_id, series_id, {date}, value FROM (SELECT entity_id, {date}, {wide} FROM {base}) "
        f"UNPIVOT INCLUDE NULLS (value FOR series_id IN ({names}))"
    )


QUARTERLY_NAMES = ", ".join(f"'{r[0]}'" for r in catalog.series_rows() if r[4] == "Q")

INTERPOLATED = (
    "SELECT entity_id, series_id, period_end, CASE WHEN value IS NOT NULL OR NOT ({gate} n > 0 AND n < n_rows * 0.5) "
    "THEN value ELSE COALESCE(lo + (hi - lo) * (i - il) / NULLIF(ih - il, 0), lo) END AS value FROM ("
    "SELECT *, COUNT(value) OVER (PARTITION BY entity_id, series_id) AS n, "
    "COUNT(*) OVER (PARTITION BY entity_id, series_id) AS n_rows, "
    f"LAST_VALUE(value IGNORE NULLS) OVER {upto()} AS lo, "
    f"LAST_VALUE(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER {upto()} AS il, "
    f"FIRST_VALUE(value IGNORE NULLS) OVER {over('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS hi, "
    f"FIRST_VALUE(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) "
    f"OVER {over('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS ih "
    f"FROM (SELECT *, ROW_NUMBER() OVER {over()} AS i FROM {{source}}))"
)

_P1 = "GREATEST(0.01e0, LEAST(0.99e0, 0.1e0 + 1.3e0 * n1 / n))"
_P2 = "GREATEST(0.01e0, LEAST(0.99e0, 0.5e0 + 0.6e0 * (nf - no) / n))"
_P3 = "GREATEST(0.01e0, LEAST(0.99e0, lo / (lo + hi) * 3.0e0))"

CTES: dict[str, str] = {
    "measures": _measures("last_day(d)", "period_end"),
    "measures_daily": _measures("d", "obs_date"),
    "obs_daily": _series("measures_daily", "obs_date", SERIES5),
    "monthly": _series("measures", "period_end", SERIES5),
    "cal": "SELECT entity_id, last_day(CAST(UNNEST(generate_series(date_trunc('month', lo), date_trunc('month', hi), "
    "INTERVAL 1 MONTH)) AS DATE)) AS period_end FROM (SELECT entity_id, MIN(period_end) AS lo, MAX(period_end) AS hi "
    "FROM measures GROUP BY 1)",
    "dense": "SELECT c.entity_id, c.period_end, m.* EXCLUDE (entity_id, period_end) FROM cal c "
    "LEFT JOIN measures m ON c.entity_id = m.entity_id AND c.period_end = m.period_end",
    "panel": _series("dense", "period_end", SERIES5),
    "quarterly": "SELECT entity_id, series_id, period_end, CASE WHEN MONTH(period_end) % 3 = 0 THEN value END AS value "
    "FROM panel WHERE series_id = 'revenue'",
    "macro_dense": "SELECT entity_id, series_id, period_end, series_id IN (" + QUARTERLY_NAMES + ") AS q, "
    "CASE WHEN NOT (series_id IN (" + QUARTERLY_NAMES + ") AND MONTH(period_end) % 3 <> 0) THEN value END AS value FROM ("
    + _series("dense", "period_end", proxies()) + ")",
    "macro": INTERPOLATED.format(gate="q AND", source="macro_dense"),
    "regime": "SELECT entity_id, period_end, CASE WHEN ROUND(value, 6) <= ROUND(q, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag "
    f"FROM (SELECT *, {guarded('QUANTILE_CONT(value, 0.2)', 'value', upto('entity_id'), 12)} AS q "
    "FROM panel WHERE series_id = 'revenue')",
    "score_rows": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_id, strftime(l_shipdate, '%Y') AS run_id, "
    "CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, m1, m2, (m1 + m2) / 2.0::DOUBLE AS m3, "
    "0.02::DOUBLE + ROUND(l_tax * 100) * 11 / 100.0::DOUBLE AS m4 FROM (SELECT *, "
    "0.05::DOUBLE + ROUND(l_discount * 100) * 9 / 100.0::DOUBLE AS m1, l_quantity / 60.0::DOUBLE AS m2 FROM lineitem)",
    "scores": "SELECT row_id, run_id, y, model, prob FROM score_rows UNPIVOT (prob FOR model IN (m1, m2, m3, m4))",
    "score_wide": "SELECT l.entity_id, l.period_end, l.flag, l.y, m1, m2, m3, (m1 + m2 + m3) / 3.0e0 AS ensemble FROM ("
    f"SELECT *, CASE WHEN COUNT(*) OVER {ahead(6, 'entity_id')} = 6 THEN MAX(flag) OVER {ahead(6, 'entity_id')} END AS y FROM regime) l "
    f"LEFT JOIN (SELECT entity_id, period_end, {_P1} AS m1, {_P2} AS m2, {_P3} AS m3 FROM measures) m "
    "ON l.entity_id = m.entity_id AND l.period_end = m.period_end",
    "score_panel": "SELECT entity_id, period_end, flag, y, model, prob FROM "
    "score_wide UNPIVOT (prob FOR model IN (m1, m2, m3, ensemble))",
    "origins": values("o", "origin, label, category, scope", [
        ("1998-06-30", "o1", "event", "in_scope"), ("1998-12-31", "o2", "expansion", "in_scope"),
        ("1999-03-31", "o3", "event", "in_scope"), ("1999-09-30", "o4", "expansion", "in_scope"),
        ("2000-02-29", "o5", "event", "in_scope"), ("2000-06-30", "o6", "expansion", "informational"),
        ("2000-10-31", "o7", "event", "in_scope"), ("2001-01-31", "o8", "expansion", "informational")]),
    "lags5": values("l", "series_id, lag_months", [("revenue", 1), ("orders", 0), ("avg_price", 2), ("urgent_share", 3)]),
    "vintages": "SELECT entity_id, 'revenue' AS series_id, obs_date, realtime_start, "
    "LEAD(realtime_start) OVER v AS realtime_end, "
    "CAST(SUM(c) OVER (PARTITION BY entity_id, obs_date ORDER BY realtime_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 103700.0e0 AS value "
    "FROM (SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, last_day(CAST(o_orderdate AS DATE)) AS obs_date, "
    "last_day(greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS realtime_start, "
    "SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) WINDOW v AS (PARTITION BY entity_id, obs_date ORDER BY realtime_start)",
    "series_catalog": values(
        "s", "series_id, category, source_id, description, native_freq, lag_months, countercyclical, block, scale, feature_pool",
        catalog.series_rows()),
}


def add(name: str, sql: str) -> str:
    """Register a further shared expression."""
    CTES[name] = sql
    return name


def complete(body: str) -> str:
    """Prepend every shared expression the text refers to, directly or through another one."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text) and re.search(rf"\b(FROM|JOIN|,)\s+\(?{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    prelude = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return prelude + ",\n" + text[5:]
    return prelude + "\n" + text
