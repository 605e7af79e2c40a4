"""Queries over the given tables, each with the SQL that tells the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a query function under its own name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTRY[f.__name__] = Query(f, sql)
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


def load() -> dict[str, Query]:
    from tessera.queries import operators, relational  # noqa: F401

    return REGISTRY
