"""Durable tables: what stays and what goes."""

from pathlib import Path

from pyspark.sql import functions as F

from tidegauge.session import durable, settled


def held(df):
    """The folders a table is read from."""
    return {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}


def test_settled_keeps_only_its_result(spark):
    seen = []

    def inner():
        seen.append(durable(spark.range(30).groupBy((F.col("id") % 7).alias("k")).count()))
        return seen[-1].where("k < 5")

    def outer():
        seen.append(settled(inner))
        return seen[-1].agg(F.sum("count").alias("n"))

    before = durable(spark.range(3))
    folders = []

    def watched():
        out = outer()
        folders.extend(f for df in seen[-1:] for f in held(df))
        return out

    result = settled(watched)
    assert result.first()["n"] == 22 and before.count() == 3
    assert folders and not any(f.exists() for f in folders)
    assert all(f.exists() for f in held(result) | held(before))


def test_shuffle_switch_is_put_back(spark):
    from tidegauge.session import SHUFFLE_CLEANUP

    old = spark.conf.get(SHUFFLE_CLEANUP)
    durable(spark.range(5).repartition(2))
    assert spark.conf.get(SHUFFLE_CLEANUP) == old
