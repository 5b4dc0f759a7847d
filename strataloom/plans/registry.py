"""Where queries register themselves with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table ``orders`` of a scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def placed(self, name: str) -> DataFrame:
        """The table with ``place``: where a row lies in the table's files, taken by name."""
        return getattr(self, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add
