"""The two streaming jobs (R05, R06), run to completion over what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.plans.registry import query
from tidegauge.session import new_table_path
from tidegauge.streaming import ingest

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


WINDOW = ["window_start", "window_end", "event_type"]


def arrivals(t, delay="1 hour"):
    return ingest.read_arrivals(t.spark, f"{t.folder}/event[s].parquet", EVENTS, delay=delay)


@query("r05_incremental_ingest", sql="SELECT event_id, event_type, ROUND(value, 6) AS value FROM events")
def r05(t):
    table, state = new_table_path(t.spark, "arrivals"), new_table_path(t.spark, "arrivals-state")
    ingest.upsert_available(arrivals(t, None), table, ["event_id"], state)
    return t.spark.read.parquet(table).select("event_id", "event_type", F.round("value", 6).alias("value"))


def alerts(t, name, *span):
    table, state = new_table_path(t.spark, name), new_table_path(t.spark, f"{name}-state")
    windows = ingest.score_windows(arrivals(t), ["event_type"], *span)
    ingest.update_available(ingest.alert_rows(windows, ["event_type"], 10.0, 60.0), table, state)
    return ingest.latest(t.spark.read.parquet(table), WINDOW)


@query("r06_score_alerts", sql="""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS volatility, ROUND(MAX(value) - MIN(value), 6) AS spread,
 STDDEV_SAMP(value) > 10 AS volatile, MAX(value) - MIN(value) > 60 AS disagree FROM events GROUP BY 1, 2""")
def r06(t):
    rows = alerts(t, "alerts", "1 day")
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select(F.to_date("window_start").alias("day"), "event_type", "n", r("mean"), r("volatility"), r("spread"), "volatile", "disagree")


@query("r06_sliding_windows", sql="""WITH w AS (SELECT event_type, value, date_trunc('day', ts) + to_hours(12 * CAST(FLOOR(EXTRACT(HOUR FROM ts) / 12) AS INT)) - to_hours(12 * CAST(k AS INT)) AS s FROM events, range(2) AS g(k))
SELECT s AS window_start, event_type, COUNT(*) AS n, ROUND(STDDEV_SAMP(value), 6) AS volatility FROM w GROUP BY 1, 2""")
def r06_sliding(t):
    rows = alerts(t, "alerts-sliding", "1 day", "12 hours")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("volatility", 6).alias("volatility"))
