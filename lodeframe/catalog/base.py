"""Registered queries: each with the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The supplied tables by attribute; read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def all(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, digits: dict | None = None):
        """Registers a query; `digits` rounds the named doubles on both sides, as sums depend on their order."""
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Tables(spark, folder))
            return df.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in (digits or {}).items()}) if digits else df

        self.queries[name] = run
        if sql is not None:
            if digits:
                swaps = ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in digits.items())
                sql = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS rounded"
            self.sql[name] = sql

