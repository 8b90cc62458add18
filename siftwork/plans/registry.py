"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, plain_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def run(spark, sf_dir):
            plain_unions(spark)
            bounded_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, places: int) -> Column:
    """x to so many places as DuckDB has it: the product in binary is rounded, not the decimal digits of x."""
    return F.round(x * float(10**places)) / float(10**places)
