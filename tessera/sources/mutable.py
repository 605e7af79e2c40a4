"""Append-only mutable tables with primary keys, over Parquet directories."""

from __future__ import annotations

import json
import re
import threading
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[a-z0-9_]{1,63}")
ALLOWED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType)


class MutableTableError(ValueError):
    pass


class NoOrderColumn(MutableTableError):
    pass


class PrimaryKeyConflict(MutableTableError):
    pass


@dataclass
class MutableTable:
    """A table definition and the directory of its appended files."""

    spark: SparkSession
    name: str
    schema: T.StructType
    primary_key: list[str]
    path: str
    order_column: str | None = None
    reserved_ok: bool = False
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise MutableTableError(f"table name {self.name!r}")
        names = self.schema.fieldNames()
        if not self.primary_key or any(k not in names for k in self.primary_key):
            raise MutableTableError("the primary key is empty or not in the schema")
        for f in self.schema.fields:
            if (f.name == "tenant_id" or f.name.startswith("_")) and not self.reserved_ok:
                raise MutableTableError(f"{f.name} is reserved")
            if not isinstance(f.dataType, ALLOWED):
                raise MutableTableError(f"{f.name}: {f.dataType.simpleString()} not implemented")
        if self.order_column and not isinstance(self.schema[self.order_column].dataType, (T.LongType, T.DecimalType)):
            raise MutableTableError("the order column is a 64-bit integer")

    @property
    def full_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("tenant_id", T.StringType())])

    def scan(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(where):
            return self.spark.createDataFrame([], self.full_schema)
        return self.spark.read.schema(self.full_schema).parquet(self.path)

    def insert(self, rows: DataFrame, tenant: str | None = None) -> int:
        """Append ``rows`` as one statement; a key that occurs twice or is there already refuses all of it."""
        missing = [c for c in self.schema.fieldNames() if c not in rows.columns]
        if missing:
            raise MutableTableError(f"columns missing: {missing}")
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(tenant).cast("string").alias("tenant_id"))
        with self._lock:
            typed = typed.cache()
            try:
                n = typed.count()
                null_key = " or ".join(f"`{k}` is null" for k in self.primary_key)
                if typed.filter(null_key).limit(1).count():
                    raise PrimaryKeyConflict("a key column is null")
                if typed.groupBy(*self.primary_key).count().filter("count > 1").limit(1).count():
                    raise PrimaryKeyConflict("a key occurs twice in the statement")
                if self.scan().join(typed.select(*self.primary_key), self.primary_key, "left_semi").limit(1).count():
                    raise PrimaryKeyConflict("a key is already in the table")
                typed.write.mode("append").parquet(self.path)
            finally:
                typed.unpersist()
        return n

    replace = insert

    def update(self, *_args, **_kwargs):
        raise NotImplementedError("mutable tables are append-only: UPDATE is not implemented")

    def delete(self, *_args, **_kwargs):
        raise NotImplementedError("mutable tables are append-only: DELETE is not implemented")

    def scan_after(self, after: int) -> DataFrame:
        if not self.order_column:
            raise NoOrderColumn(self.name)
        return self.scan().filter(F.col(self.order_column) > after).orderBy(self.order_column)

    def definition(self) -> dict:
        return {"name": self.name, "schema": json.loads(self.schema.json()), "primary_key": self.primary_key, "path": str(PurePosixPath(self.path)), "order_column": self.order_column}
