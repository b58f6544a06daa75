"""Registry that pairs every query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from . import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and to the concept views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in bindings.TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def frames(self) -> DataFrame:
        return bindings.frames(self.events)

    @cached_property
    def rows(self) -> DataFrame:
        return bindings.rows(self.lineitem)

    @cached_property
    def met(self) -> DataFrame:
        return bindings.metrics(self.lineitem)

    @cached_property
    def jobs(self) -> DataFrame:
        return bindings.jobs(self.orders)

    @cached_property
    def job_frames(self) -> DataFrame:
        return bindings.job_frames(self.lineitem)


def query(key: str, sql: str | None = None):
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = bindings.with_views(sql)
        return fn

    return add
