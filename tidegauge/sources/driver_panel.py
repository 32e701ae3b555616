"""Panels derived from the order and event tables, so that every operator runs on given data.

An entity is a nation. One row of ``measures`` is a nation-month; all series below are
fixed arithmetic on its counts and sums, so any engine derives identical doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import align
from tidegauge.sources import catalog

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Money is in thousands at a fixed exchange rate of 1.037, which also keeps averages away from
# decimal ties. Expressions valid in Spark SQL and in any ANSI engine alike.
SERIES5 = {
    "revenue": "cents / 103700.0e0",
    "orders": "n",
    "avg_price": "cents / 103700.0e0 / n",
    "urgent_share": "n1 / n",
    "failed_share": "nf / n",
}
LEVELS = ["cents / 103700.0e0", "n", "cents / 103700.0e0 / n", "hi / 103700.0e0", "lo / 103700.0e0 + 1.0e0", "n1 + 1.0e0", "n3 + 2.0e0"]


def proxy_expression(i: int, source_id: str) -> str:
    """Arithmetic that stands in for catalogue series number ``i``."""
    a, b = i % 5 + 1, (i + 2) % 5 + 1
    if source_id in catalog.SPREADS:
        return f"100.0e0 * (n{a} - n{b}) / n"
    if source_id in catalog.RATES:
        return f"100.0e0 * n{a} / n"
    return LEVELS[i % len(LEVELS)]


def proxies() -> dict[str, str]:
    rows = [r for r in catalog.series_rows() if r[1] != "target"]
    return {r[0]: proxy_expression(i, r[2]) for i, r in enumerate(rows)}


def month_of(ts: str) -> Column:
    return F.last_day(F.to_date(ts))


class DriverTables:
    """Lazy frames over one data folder. Nothing is executed or collected here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def dated_orders(self) -> DataFrame:
        customers = self.read("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("entity_id"))
        orders = self.read("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("obs_date"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"),
        )
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))

    def _measure(self, date: Column, name: str) -> DataFrame:
        count = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0))
        aggs = [F.sum(F.lit(1.0)).alias("n"), F.sum("c").cast("double").alias("cents"),
                F.max("c").cast("double").alias("hi"), F.min("c").cast("double").alias("lo")]
        aggs += [count(F.col("o_orderpriority") == p).alias(f"n{i}") for i, p in enumerate(PRIORITIES, 1)]
        aggs += [count(F.col("o_orderstatus") == s).alias(f"n{s.lower()}") for s in "FOP"]
        return self.dated_orders.groupBy("entity_id", date.alias(name)).agg(*aggs)

    @cached_property
    def measures(self) -> DataFrame:
        return self._measure(F.last_day("obs_date"), "period_end")

    def _explode(self, base: DataFrame, date: str, series: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("series_id"), F.expr(e).alias("value")) for k, e in series.items()])
        return base.select("entity_id", date, F.inline(pairs)).select("entity_id", "series_id", date, "value")

    @cached_property
    def obs_daily(self) -> DataFrame:
        return self._explode(self._measure(F.col("obs_date"), "obs_date"), "obs_date", SERIES5)

    @cached_property
    def obs(self) -> DataFrame:
        return self._explode(self.measures, "period_end", SERIES5).withColumnRenamed("period_end", "obs_date")

    @cached_property
    def monthly(self) -> DataFrame:
        return self.obs.withColumnRenamed("obs_date", "period_end")

    @cached_property
    def panel(self) -> DataFrame:
        return align.dense_calendar(self.monthly)

    @cached_property
    def quarterly(self) -> DataFrame:
        keep = F.when(F.month("period_end") % 3 == 0, F.col("value"))
        return self.panel.where("series_id = 'revenue'").withColumn("value", keep)

    @cached_property
    def macro_monthly(self) -> DataFrame:
        long = self._explode(self.measures, "period_end", proxies())
        quarterly = [r[0] for r in catalog.series_rows() if r[4] == "Q"]
        off_quarter = F.col("series_id").isin(quarterly) & (F.month("period_end") % 3 != 0)
        return long.withColumn("value", F.when(~off_quarter, F.col("value")))

    @cached_property
    def macro(self) -> DataFrame:
        """All catalogue series as a dense monthly panel, quarterly ones interpolated."""
        dense = align.dense_calendar(self.macro_monthly)
        quarterly = [r[0] for r in catalog.series_rows() if r[4] == "Q"]
        return align.interpolate_quarterly(dense.withColumn("_q", F.col("series_id").isin(quarterly)), quarterly_only="_q")

    @cached_property
    def regime(self) -> DataFrame:
        """0/1 event flag per nation-month: revenue at or below its expanding 20 % quantile."""
        w = W.by("entity_id")
        q = W.expanding_quantile("value", 0.2, w, 12)
        return (
            self.panel.where("series_id = 'revenue'").withColumn("_q", q)
            .select("entity_id", "period_end", W.flag(F.round("value", 6) <= F.round("_q", 6)).alias("flag"))
        )

    @cached_property
    def score_rows(self) -> DataFrame:
        """One scored row per line item: label, run (ship year), four members."""
        disc, qty, tax = F.round(F.col("l_discount") * 100), F.col("l_quantity"), F.round(F.col("l_tax") * 100)
        m1, m2 = 0.05 + disc * 9 / 100.0, qty / 60.0
        return self.read("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
            F.date_format("l_shipdate", "yyyy").alias("run_id"),
            F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
            m1.alias("m1"), m2.alias("m2"), ((m1 + m2) / 2.0).alias("m3"), (0.02 + tax * 11 / 100.0).alias("m4"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        names = ["m1", "m2", "m3", "m4"]
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in names])
        return self.score_rows.select("row_id", "run_id", "y", F.inline(pairs))

    @cached_property
    def score_wide(self) -> DataFrame:
        """Monthly member probabilities per nation with the event flag and its 6-month forward label."""
        p1 = "greatest(0.01e0, least(0.99e0, 0.1e0 + 1.3e0 * n1 / n))"
        p2 = "greatest(0.01e0, least(0.99e0, 0.5e0 + 0.6e0 * (nf - no) / n))"
        p3 = "greatest(0.01e0, least(0.99e0, lo / (lo + hi) * 3.0e0))"
        base = self.measures.select(
            "entity_id", "period_end", F.expr(p1).alias("m1"), F.expr(p2).alias("m2"), F.expr(p3).alias("m3")
        ).withColumn("ensemble", F.expr("(m1 + m2 + m3) / 3.0e0"))
        w = W.by("entity_id")
        labels = self.regime.withColumn("y", W.forward_max("flag", 6, w))
        return labels.join(base, ["entity_id", "period_end"], "left")

    @cached_property
    def score_panel(self) -> DataFrame:
        names = ["m1", "m2", "m3", "ensemble"]
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in names])
        return self.score_wide.select("entity_id", "period_end", "flag", "y", F.inline(pairs)).where("prob is not null")

    @cached_property
    def origins(self) -> DataFrame:
        rows = [
            ("1998-06", "o1", "event", "in_scope"), ("1998-12", "o2", "expansion", "in_scope"),
            ("1999-03", "o3", "event", "in_scope"), ("1999-09", "o4", "expansion", "in_scope"),
            ("2000-02", "o5", "event", "in_scope"), ("2000-06", "o6", "expansion", "informational"),
            ("2000-10", "o7", "event", "in_scope"), ("2001-01", "o8", "expansion", "informational"),
        ]
        return catalog.origins(self.spark, rows)

    @cached_property
    def lags5(self) -> DataFrame:
        rows = [("revenue", 1), ("orders", 0), ("avg_price", 2), ("urgent_share", 3)]
        return catalog.dimension(self.spark, rows, "series_id STRING, lag_months INT")

    @cached_property
    def vintages(self) -> DataFrame:
        """Bitemporal revenue: an order month grows as its items become known.

        ``realtime_start`` is the month end on which a version appears, ``realtime_end``
        the next version's start. Items are summed per (nation, order month, known month)
        before any window runs.
        """
        orders = self.dated_orders.select("o_orderkey", "entity_id", "obs_date")
        items = self.read("lineitem").select(
            "l_orderkey", F.to_date("l_shipdate").alias("ship"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        )
        known = (
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("entity_id", F.last_day("obs_date").alias("obs_date"),
                     F.last_day(F.greatest("ship", "obs_date")).alias("realtime_start"))
            .agg(F.sum("c").alias("c"))
        )
        w = W.by("entity_id", "obs_date", order="realtime_start")
        return known.select(
            "entity_id", F.lit("revenue").alias("series_id"), "obs_date", "realtime_start",
            F.lead("realtime_start").over(w).alias("realtime_end"),
            (F.sum("c").over(W.expanding(w)).cast("double") / 103700.0).alias("value"),
        )
