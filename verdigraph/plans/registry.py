"""Registration of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigraph import facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Facts:
    """The fact tables of one directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return facts.fact(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register a function of Facts under its own name, with SQL over the fact views."""

    def wrap(fn: Callable[[Facts], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = facts.oracle(sql)
        return fn

    return wrap
