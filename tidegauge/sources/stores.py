"""Durable tables: vintages with their coverage, scores, features, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge import schemas

VINTAGE_KEY = ["entity_id", "series_id", "obs_date", "realtime_start"]


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    """Append rows. Rows of one partition value are spread over several files, so that a hot value has no single writer."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return path


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """The bitemporal table without repeats: a version that was appended twice counts once."""
    return spark.read.schema(schemas.OBS_VINTAGE).parquet(path).dropDuplicates(VINTAGE_KEY)


def coverage(vintages: DataFrame, requests: DataFrame) -> DataFrame:
    """Status of every requested (series, as-of): ``ok`` or ``empty``, the negative cache."""
    asof = requests.select("series_id", "asof")
    known = vintages.groupBy("series_id").agg(F.min("realtime_start").alias("_first"))
    status = F.when(F.col("_first") <= F.col("asof"), "ok").otherwise("empty")
    return asof.join(known, "series_id", "left").select("series_id", "asof", status.alias("status"))


def still_to_load(requests: DataFrame, covered: DataFrame, refetch_empty: bool = False) -> DataFrame:
    done = covered.where("status = 'ok'") if refetch_empty else covered
    return requests.join(done.select("series_id", "asof"), ["series_id", "asof"], "left_anti")


def write_scores(scores: DataFrame, path: str) -> str:
    return append(scores, path, ["run_id"])


def read_scores(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Stored scores; the run filter prunes partitions. Rows without a date are dropped."""
    df = spark.read.schema(schemas.SCORES).parquet(path).dropna(subset=["period_end"])
    return df.where(F.col("run_id") == run_id) if run_id else df


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide predictions as text: ``Date`` is required, bad dates are dropped."""
    df = spark.read.option("header", True).csv(path)
    if "Date" not in df.columns:
        raise ValueError("predictions need a Date column")
    return df.withColumn("period_end", F.to_date(F.try_to_timestamp("Date"))).where("period_end is not null")


def run_manifest(scores: DataFrame, metrics: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """One row per run: size, latest dates, headline metrics."""
    size = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("period_end").alias("latest_prediction"), F.max(F.when(F.col("y").isNotNull(), F.col("period_end"))).alias("latest_known"),
        F.count_distinct("model").alias("n_models"))
    return size.join(metrics, keys, "left")


def incumbent(runs: DataFrame, keys: list[str] = []) -> DataFrame:
    """The latest run with its text fields coerced; unusable values fall back to defaults."""
    fields = F.struct("run_id", "candidate_id", "max_features", "n_cv_splits")
    last = runs.groupBy(*(keys or [F.lit(1).alias("_k")])).agg(F.max_by(fields, "run_id").alias("r"))
    number = lambda c, default: F.coalesce(F.col(f"r.{c}").try_cast("int"), F.lit(default)).alias(c)
    return last.select(*keys, "r.run_id", F.coalesce("r.candidate_id", F.lit("baseline_50")).alias("candidate_id"), number("max_features", 50), number("n_cv_splits", 5))


def latest_per(df: DataFrame, keys: list[str], order: str = "period_end") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
