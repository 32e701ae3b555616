"""Incremental jobs on Structured Streaming: re-ingest of observations, alerts on new scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrivals(spark: SparkSession, glob: str, schema: str, ts: str = "ts", delay: str | None = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream. Event times are cast to TIMESTAMP: watermarks reject zone-less ones. No watermark without ``delay``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(glob).withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, delay) if delay else rows


def score_windows(scores: DataFrame, keys: list[str], size: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Volatility and spread of scores per (key, window); rows later than the watermark are dropped."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return scores.groupBy(span.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("volatility"), (F.max(value) - F.min(value)).alias("spread"))


def alert_rows(windows: DataFrame, keys: list[str], volatility: float, spread: float) -> DataFrame:
    return windows.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean", "volatility", "spread",
        (F.col("volatility") > volatility).alias("volatile"), (F.col("spread") > spread).alias("disagree"))


def _run_batches(stream: DataFrame, write, checkpoint: str, mode: str) -> None:
    """Process everything that has landed, batch by batch, and stop. Re-running resumes from the checkpoint."""
    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def upsert_available(stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> None:
    """Add every key once, however late or often it arrives.

    A batch is written to a folder of its own, without the keys of earlier batches; a repeated batch replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if number:
            known = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{table}/batch={n}" for n in range(number)])
            new = new.join(known.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")

    _run_batches(stream, write, checkpoint, "append")


def update_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Write the rows that each batch changed; open windows are among them. ``latest`` reads the last state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    _run_batches(stream, write, checkpoint, "update")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key from a table of updates (column ``batch``)."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
