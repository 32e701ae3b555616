"""Alignment, reshaping and real-time masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import month_end, month_key, ratio, shift_months
from tidegauge.operators import align
from tidegauge.plans import oracle_base as B
from tidegauge.plans.registry import query
from tidegauge.sources.driver_panel import DriverTables

PANEL = "entity_id, series_id, period_end"


@query("a01_month_end_last", sql="""
SELECT entity_id, series_id, last_day(obs_date) AS period_end, ROUND(arg_max(value, obs_date), 6) AS value
FROM obs_daily WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def a01(t: DriverTables):
    return align.month_end_last(t.obs_daily).withColumn("value", F.round("value", 6))


@query("a02_dense_calendar", sql=f"SELECT {PANEL}, ROUND(value, 6) AS value FROM panel")
def a02(t):
    return align.dense_calendar(t.monthly).withColumn("value", F.round("value", 6))


@query("a03_outer_alignment", sql="""
SELECT entity_id, period_end, ROUND(MAX(value) FILTER (series_id = 'revenue'), 6) AS revenue,
  ROUND(MAX(value) FILTER (series_id = 'orders'), 6) AS orders, ROUND(MAX(value) FILTER (series_id = 'failed_share'), 6) AS failed_share
FROM monthly GROUP BY 1, 2""")
def a03(t):
    names = ["revenue", "orders", "failed_share"]
    wide = align.pivot_wide(t.monthly, names)
    return wide.select("entity_id", "period_end", *[F.round(n, 6).alias(n) for n in names])


@query("a04_interpolate", sql=f"SELECT {PANEL}, ROUND(value, 6) AS value FROM ({B.INTERPOLATED.format(gate='', source='quarterly')})")
def a04(t):
    return align.interpolate_quarterly(t.quarterly).withColumn("value", F.round("value", 6))


@query("a05_forward_fill", sql=f"SELECT {PANEL}, ROUND(LAST_VALUE(value IGNORE NULLS) OVER {B.upto()}, 6) AS value FROM quarterly")
def a05(t):
    return align.forward_fill(t.quarterly).withColumn("value", F.round("value", 6))


@query("a06_fill_zero", sql=f"SELECT {PANEL}, ROUND(COALESCE(value, 0.0), 6) AS value FROM quarterly")
def a06(t):
    return align.fill_zero(t.quarterly).withColumn("value", F.round("value", 6))


@query("a07_fill_mean", sql=f"""
SELECT {PANEL}, ROUND(COALESCE(value, AVG(value) OVER (PARTITION BY entity_id, series_id)), 5) AS value FROM quarterly""")
def a07(t):
    return align.fill_mean(t.quarterly).withColumn("value", F.round("value", 5))


@query("a08_reindex", sql="""
SELECT c.entity_id, c.period_end, ROUND(q.value, 6) AS value FROM cal c
LEFT JOIN (SELECT * FROM quarterly WHERE value IS NOT NULL) q ON c.entity_id = q.entity_id AND c.period_end = q.period_end""")
def a08(t):
    calendar = t.panel.where("series_id = 'revenue'").select("entity_id", "period_end")
    readings = t.quarterly.where("value is not null").select("entity_id", "period_end", F.round("value", 6).alias("value"))
    return align.reindex(calendar, readings, ["entity_id", "period_end"])


@query("a09_as_of_trim", sql=f"""
SELECT origin, {PANEL}, ROUND(value, 6) AS value FROM panel JOIN origins ON period_end <= origin""")
def a09(t):
    return align.as_of(t.panel, t.origins).select("origin", *align.KEYS, "period_end", F.round("value", 6).alias("value"))


MASKED = B.add("masked", """
SELECT origin, entity_id, series_id, period_end, CASE WHEN r > lag THEN value END AS value FROM (
  SELECT o.origin, p.entity_id, p.series_id, p.period_end, p.value, COALESCE(l.lag_months, 1) AS lag,
    ROW_NUMBER() OVER (PARTITION BY o.origin, p.entity_id, p.series_id ORDER BY p.period_end DESC) AS r
  FROM panel p JOIN origins o ON p.period_end <= o.origin LEFT JOIN lags5 l ON p.series_id = l.series_id)""")


def masked(t: DriverTables):
    return align.lag_mask(align.as_of(t.panel, t.origins), t.lags5, keys=["origin", *align.KEYS]).select(
        "origin", *align.KEYS, "period_end", "value")


@query("a10_publication_lag_mask", sql=f"SELECT origin, {PANEL}, ROUND(value, 6) AS value FROM masked")
def a10(t):
    return masked(t).withColumn("value", F.round("value", 6))


@query("a10_publication_lag_shift", sql=f"""
SELECT {PANEL}, ROUND(CASE COALESCE(lag_months, 1) WHEN 0 THEN value WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END, 6) AS value
FROM (SELECT *, LAG(value, 1) OVER {B.over()} AS v1, LAG(value, 2) OVER {B.over()} AS v2, LAG(value, 3) OVER {B.over()} AS v3 FROM panel)
LEFT JOIN lags5 USING (series_id)""")
def a10_shift(t):
    return align.lag_mask(t.panel, t.lags5, mode="shift").select(*align.KEYS, "period_end", F.round("value", 6).alias("value"))


@query("a11_month_end", sql="""
SELECT entity_id, last_day(obs_date) AS period_end, COUNT(*) AS n FROM obs_daily GROUP BY 1, 2""")
def a11(t):
    return t.obs_daily.groupBy("entity_id", month_end("obs_date").alias("period_end")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_month_arithmetic", sql="""
SELECT entity_id, period_end, last_day(period_end - INTERVAL 6 MONTH) AS label_cutoff,
  last_day(period_end - INTERVAL 36 MONTH) AS three_years_back, last_day(period_end + INTERVAL 1 MONTH) AS next_month
FROM regime""")
def a12(t):
    d = "period_end"
    return t.regime.select(
        "entity_id", d, shift_months(d, -6).alias("label_cutoff"), shift_months(d, -36).alias("three_years_back"),
        shift_months(d, 1).alias("next_month"))


B.add("vintage_known", """
SELECT o.origin, v.entity_id, v.series_id, v.obs_date AS period_end, v.value AS vintage_value FROM vintages v
JOIN origins o ON v.realtime_start <= o.origin AND (v.realtime_end IS NULL OR o.origin < v.realtime_end) AND v.obs_date <= o.origin""")
B.add("realtime", """
SELECT m.origin, m.entity_id, m.series_id, m.period_end,
  CASE WHEN m.series_id = 'revenue' AND BOOL_OR(k.vintage_value IS NOT NULL) OVER (PARTITION BY m.origin, m.entity_id, m.series_id)
  THEN k.vintage_value ELSE m.value END AS value
FROM masked m LEFT JOIN vintage_known k ON m.origin = k.origin AND m.entity_id = k.entity_id
  AND m.series_id = k.series_id AND m.period_end = k.period_end""")


def realtime_panel(t: DriverTables):
    trimmed = align.as_of(t.panel, t.origins)
    return align.substitute_vintages(masked(t), trimmed, align.known_vintage(t.vintages, t.origins), ["revenue"])


@query("a13_vintage_asof", sql=f"SELECT origin, {PANEL}, ROUND(value, 6) AS value FROM realtime")
def a13(t):
    return realtime_panel(t).select("origin", *align.KEYS, "period_end", F.round("value", 6).alias("value"))


@query("a14_vintage_coverage", sql="""
WITH want AS (SELECT DISTINCT origin, entity_id, s.series_id FROM masked, (VALUES ('revenue'), ('orders'), ('backlog')) AS s(series_id)),
have AS (SELECT DISTINCT origin, entity_id, series_id FROM masked),
got AS (SELECT origin, entity_id, series_id, COUNT(vintage_value) AS n FROM vintage_known GROUP BY 1, 2, 3),
st AS (SELECT w.*, CASE WHEN h.origin IS NULL THEN 'missing_in_frame' WHEN g.n IS NULL THEN 'alfred_unavailable'
  WHEN g.n > 0 THEN 'alfred_ok' ELSE 'alfred_empty_after_align' END AS status
  FROM want w LEFT JOIN have h USING (origin, entity_id, series_id) LEFT JOIN got g USING (origin, entity_id, series_id))
SELECT origin, series_id, status, COUNT(*) AS attempts, COUNT(*) FILTER (status = 'alfred_ok') AS hits FROM st GROUP BY 1, 2, 3""")
def a14(t):
    core = ["revenue", "orders", "backlog"]
    status = align.vintage_coverage_status(
        align.as_of(t.panel, t.origins), align.known_vintage(t.vintages, t.origins), core)
    return status.groupBy("origin", "series_id", "status").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "alfred_ok").alias("hits"))


@query("a15_no_infinities", sql=f"""
SELECT {PANEL}, ROUND(value / NULLIF(prev, 0) - 1, 6) AS growth FROM (SELECT *, LAG(value) OVER {B.over()} AS prev FROM panel)""")
def a15(t):
    growth = ratio("value", F.lag("value").over(W.series_window())) - 1
    return t.panel.select(*align.KEYS, "period_end", F.round(growth, 6).alias("growth"))


@query("a16_month_key", sql="SELECT strftime(period_end, '%Y-%m') AS month_key, SUM(flag) AS in_event, COUNT(*) AS n FROM regime GROUP BY 1")
def a16(t):
    return t.regime.groupBy(month_key("period_end").alias("month_key")).agg(
        F.sum("flag").alias("in_event"), F.count(F.lit(1)).alias("n"))


@query("a17_parse_and_sort_dates", sql="""
SELECT source, doc_id, TRY_CAST(raw AS DATE) AS period_end FROM (
  SELECT source, doc_id, CASE WHEN n_chars % 3 = 0 THEN 'n/a' ELSE concat('20', lpad(CAST(n_chars % 30 AS VARCHAR), 2, '0'), '-',
    lpad(CAST(n_chars % 14 AS VARCHAR), 2, '0'), '-10') END AS raw FROM documents) WHERE TRY_CAST(raw AS DATE) IS NOT NULL""")
def a17(t):
    two = lambda e: F.lpad(e.cast("string"), 2, "0")
    n = F.col("n_chars")
    raw = F.when(n % 3 == 0, "n/a").otherwise(F.concat(F.lit("20"), two(n % 30), F.lit("-"), two(n % 14), F.lit("-10")))
    return align.parse_dates(t.read("documents").withColumn("raw", raw), "raw", "period_end").select(
        "source", "doc_id", "period_end")
