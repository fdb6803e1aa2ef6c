"""Where modules of queries register them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def registered(sql: str | None = None):
    """Register a function under its own name, with SQL of equal results."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
