"""Registry of runnable queries, each with the equivalent SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import scratch_path, tune

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register a query ``Tables -> DataFrame`` under a name, with its SQL."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(tune(spark), folder))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return function

    return register


def nulled(value: str | Column, key: str, every: int) -> Column:
    """``value``, or null in each row whose key is a multiple of ``every``."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(F.col(key) % every != 0, col)


def fresh_name(prefix: str) -> str:
    """Unused table or view name."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
