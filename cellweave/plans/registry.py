"""Registry of the queries that ``__spark_entry__`` offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, queries: dict | None = None, oracle: dict | None = None):
    """Register a function of (spark, folder of the tables) under ``name``, with the SQL that must give the same rows."""

    def put(f):
        (QUERIES if queries is None else queries)[name] = f
        if sql:
            (SQL if oracle is None else oracle)[name] = sql
        return f

    return put


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
