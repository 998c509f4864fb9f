"""Registered queries: each with the Spark job and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(load) -> DataFrame`` where ``load(table)`` reads one of the given tables."""

    def register(build: Callable[[Tables], DataFrame]):
        REGISTERED[name] = Query(lambda spark, sf_dir: build(Tables(spark, sf_dir)), sql)
        return build

    return register


class Tables:
    """The given tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def all(self) -> dict[str, DataFrame]:
        return {name: self(name) for name in TABLES}
