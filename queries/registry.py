from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table dealt evenly over the session's partitions: what follows costs more a row than the
    shuffle, and files with few row groups would be few tasks."""
    return table(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
