"""Registered sources: files by format, and databases over JDBC."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import norm

R = TypeVar("R")
EXTENSIONS = {"parquet": ".parquet", "csv": ".csv", "json": ".json"}
SCHEMES = ("file", "memory", "s3", "s3a", "gs", "gcs", "azure", "abfss", "r2", "hdfs", "viewfs")


@dataclass(frozen=True)
class Source:
    """A registration: where rows are and how they are read."""

    url: str
    format: str = "parquet"
    file_extension: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    tenant_column: str | None = None

    def to_json(self) -> dict:
        return asdict(self)

    def read(self, spark: SparkSession, table: str | None = None) -> DataFrame:
        scheme = self.url.split("://", 1)[0] if "://" in self.url else "file"
        if self.format in ("postgres", "mysql"):
            return spark.read.format("jdbc").options(url=self.url, dbtable=table or self.options.get("dbtable", ""), **self.options).load()
        if self.format == "avro":
            raise NotImplementedError("Avro not yet supported")
        if self.format not in EXTENSIONS:
            raise ValueError(f"format {self.format}")
        if scheme not in SCHEMES:
            raise ValueError(f"scheme {scheme}")
        reader = spark.read.options(**self.options)
        if self.file_extension:
            reader = reader.option("pathGlobFilter", f"*{self.file_extension}")
        if self.format == "csv":
            return reader.option("header", self.options.get("header", "true")).option("inferSchema", "true").csv(self.url)
        return reader.json(self.url) if self.format == "json" else reader.parquet(self.url)


def with_retry(call: Callable[[], R], retryable: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), attempts: int = 4, first_wait: float = 0.1) -> R:
    """``call`` again after transient errors, with doubling waits; others pass at once."""
    for attempt in range(attempts):
        try:
            return call()
        except retryable:
            if attempt + 1 == attempts:
                raise
            time.sleep(first_wait * 2**attempt)
    raise AssertionError("unreachable")


def import_embeddings(rows: DataFrame, dimensions: int, source_id: str, model_id: str) -> DataFrame:
    """``(_row_id, vector)`` as an embedding table: widths checked, unit length; a zero or non-finite norm raises."""
    v = F.col("vector").cast("array<double>")
    length = norm(v)
    right = F.when(F.size("vector") == dimensions, length).otherwise(F.raise_error(F.concat(F.lit(f"width is not {dimensions}: "), F.col("_row_id").cast("string"))).cast("double"))
    fine = F.when((right > 0) & (right < float("inf")), right).otherwise(F.raise_error(F.concat(F.lit("no direction: "), F.col("_row_id").cast("string"))).cast("double"))
    return rows.select(
        F.col("_row_id").cast("string").alias("_row_id"), F.lit(source_id).alias("_source_id"), F.lit(model_id).alias("_model_id"),
        F.transform(v, lambda x: (x / fine).cast("float")).alias("vector"),
    )


def read_vectors(table: DataFrame) -> DataFrame:
    return table.select("vector")


def read_keyed_vectors(table: DataFrame) -> DataFrame:
    return table.select("_row_id", "vector")


def read_vector_by_key(table: DataFrame, key: str) -> list[float] | None:
    found = table.filter(F.col("_row_id") == key).select("vector").limit(1).collect()
    return list(found[0][0]) if found else None
