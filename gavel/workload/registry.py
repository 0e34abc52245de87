"""Registry of queries over the driver tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavel.session import tune


class Tables:
    """The driver's tables under one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        # Kept, so that a query using a table twice lists its files and reads its schema once.
        table = self.spark.read.parquet(self.path(name))
        setattr(self, name, table)
        return table


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`; without ``sql`` only its rows are checked."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(tune(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
