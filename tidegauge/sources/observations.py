"""Loading observations and checking the input contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas

OBSERVATION = "array<struct<date: string, value: string>>"
START = "1970-01-01"


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.OBS, **options) -> DataFrame:
    """Landed files (parquet, csv, json) under an explicit schema; nothing is inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def load(obs: DataFrame, catalog: DataFrame, start: str = START, end: str | None = None) -> DataFrame:
    """Date range, then the category prefix. Series that delivered nothing simply have no rows."""
    kept = obs.where(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        kept = kept.where(F.col("obs_date") <= F.lit(end).cast("date"))
    names = catalog.select(F.col("source_id"), F.col("series_id").alias("name"))
    return kept.join(names, kept["series_id"] == names["source_id"]).select("entity_id", F.col("name").alias("series_id"), "obs_date", "value")


def parse_payload(df: DataFrame, text: str = "payload") -> DataFrame:
    """Observation payloads as delivered: bad dates are dropped, bad values become NULL."""
    rows = df.select("entity_id", "series_id", F.inline(F.from_json(F.get_json_object(text, "$.observations"), OBSERVATION)))
    date = F.to_date(F.try_to_timestamp("date"))
    return rows.select("entity_id", "series_id", date.alias("obs_date"), F.col("value").try_cast("double").alias("value")).where("obs_date is not null")


def require_series(obs: DataFrame, series: str) -> DataFrame:
    """Pass the rows on; the job stops with a message when the critical series is empty."""
    n = obs.where(F.col("series_id") == series).agg(F.count("value").alias("n"))
    checked = n.select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"critical series {series} is empty"))).otherwise(F.col("n")).alias("n_values"))
    return checked


def quality_gate(obs: DataFrame, required: list[str], label: str, min_series: int = 35, min_label: int = 100, min_rows: int = 500, strict: bool = True) -> DataFrame:
    """One aggregate per entity: series, label months, periods, missing anchors. ``strict`` stops the job on a violation."""
    anchors = F.array(*[F.lit(r) for r in required])
    stats = obs.where("value is not null").groupBy("entity_id").agg(
        F.count_distinct("series_id").alias("n_series"), F.count_if(F.col("series_id") == label).alias("n_label"), F.count_distinct("period_end").alias("n_periods"),
        F.collect_set(F.when(F.col("series_id").isin([*required, label]), F.col("series_id"))).alias("_have"))
    missing = F.array_join(F.array_sort(F.array_except(anchors, "_have")), ",")
    ok = (F.col("n_series") >= min_series) & (F.col("n_label") >= min_label) & (F.col("n_periods") > min_rows) & (F.col("missing_anchors") == "")
    out = stats.withColumn("missing_anchors", missing).withColumn("passed", ok).drop("_have")
    if strict:
        out = out.withColumn("passed", F.when(~F.col("passed"), F.raise_error(F.concat(F.lit("input quality gate failed for "), "entity_id"))).otherwise(F.lit(True)))
    return out


def missing_profile(panel: DataFrame, top: int = 10) -> DataFrame:
    share: Column = 1 - F.count("value") / F.count(F.lit(1))
    return panel.groupBy("series_id").agg(share.alias("missing_share")).orderBy(F.round("missing_share", 9).desc(), "series_id").limit(top)


def freshness(rows: DataFrame, keys: list[str], as_of: str, limit_days: int, date: str = "period_end") -> DataFrame:
    latest = rows.groupBy(*keys).agg(F.max(date).alias("latest"))
    age = F.datediff(F.lit(as_of).cast("date"), "latest")
    return latest.withColumns({"days_old": age, "stale": age > limit_days})
