"""Query registry: a name, a Spark plan over the driver tables, and optionally its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans import oracle_base
from tidegauge.sources.driver_panel import DriverTables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[DriverTables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, longs: tuple[str, ...] = ()):
    """Register a plan. ``longs`` names counters that the oracle types as BIGINT."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        typed = (lambda t: build(t).withColumns({c: F.col(c).cast("bigint") for c in longs})) if longs else build
        REGISTRY[name] = Query(name, typed, oracle_base.complete(sql) if sql else None)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return REGISTRY[name].build(DriverTables(spark, folder))
