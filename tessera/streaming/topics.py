"""Topics: durable offset logs with replay and a live tail by Structured Streaming.

A publish appends one Parquet batch whose rows share ``_offset``; ``_row_idx``
numbers them.  Replay is a pruned scan (``_offset`` is pushed down); the live tail
is a file stream over the same directory, filtered to offsets past the replay,
so a row is seen once, or twice at the seam under the key (_offset, _row_idx).
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.streaming.predicate import matching

PREFIX = [T.StructField("_offset", T.LongType(), False), T.StructField("_row_idx", T.LongType(), False), T.StructField("_produced_at", T.LongType(), False)]


class SchemaConflict(ValueError):
    pass


@dataclass
class Topic:
    spark: SparkSession
    name: str
    schema: T.StructType
    path: str
    tenant: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([*PREFIX, *self.schema.fields, T.StructField("tenant_id", T.StringType())])

    def log(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(where):
            store.mkdirs(where)
        return self.spark.read.schema(self.log_schema).parquet(self.path)

    def next_offset(self) -> int:
        return self.log().agg(F.coalesce(F.max("_offset") + 1, F.lit(0).cast("long"))).first()[0]

    def publish(self, batch: DataFrame, tenant: str | None = None) -> int:
        """Append a batch of exactly the topic's schema; returns its offset."""
        have = [(f.name, f.dataType) for f in batch.schema.fields]
        if have != [(f.name, f.dataType) for f in self.schema.fields]:
            raise SchemaConflict(f"{self.name}: {batch.schema.simpleString()}")
        if self.tenant is not None and tenant != self.tenant:
            raise PermissionError("the topic belongs to another tenant")
        with self._lock:
            offset = self.next_offset()
            rows = batch.coalesce(1).withColumn("_row_idx", F.monotonically_increasing_id())  # one published batch: one file
            rows = rows.select(F.lit(offset).cast("long").alias("_offset"), "_row_idx", F.lit(int(time.time() * 1e6)).cast("long").alias("_produced_at"), *self.schema.fieldNames(), F.lit(tenant).cast("string").alias("tenant_id"))
            rows.write.mode("append").parquet(self.path)
        return offset

    def _mine(self, df: DataFrame, tenant: str | None) -> DataFrame:
        own = F.col("tenant_id").isNull()
        return df.filter(own if tenant is None else own | (F.col("tenant_id") == tenant))

    def replay(self, predicate: str | None = None, from_offset: int | None = None, tenant: str | None = None) -> DataFrame:
        """Logged rows from an offset on; no offset, no rows."""
        rows = self._mine(self.log(), tenant).filter(F.col("_offset") >= from_offset) if from_offset is not None else self.log().limit(0)
        return matching(rows, predicate)

    def subscribe(self, predicate: str | None = None, after_offset: int = -1, tenant: str | None = None) -> DataFrame:
        """A streaming DataFrame of the rows past an offset."""
        self.log()
        live = self.spark.readStream.schema(self.log_schema).parquet(self.path)
        return matching(self._mine(live, tenant).filter(F.col("_offset") > after_offset), predicate)

    def collect(self, predicate: str | None = None, from_offset: int | None = None, max_batches: int = 64, tenant: str | None = None) -> DataFrame:
        """Rows of the first ``max_batches`` published batches that the predicate matches in."""
        return first_batches(self.replay(predicate, from_offset, tenant), max_batches)


def first_batches(rows: DataFrame, max_batches: int) -> DataFrame:
    offsets = rows.select("_offset").distinct().orderBy("_offset").limit(max_batches)
    return rows.join(F.broadcast(offsets), "_offset", "left_semi")


def batches(rows: DataFrame) -> DataFrame:
    """``(_offset, n, rows)``: rows back in their published batches; a batch is one publish, so its size is the publisher's."""
    body = F.struct("_row_idx", *(c for c in rows.columns if not c.startswith("_")))
    return rows.groupBy("_offset").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(body)).alias("rows"))


def windowed(events: DataFrame, time_column: str, size: str, slide: str | None = None, lateness: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in event-time windows, with a watermark where ``events`` is a stream."""
    if events.isStreaming:
        events = events.withWatermark(time_column, lateness)
    return events.groupBy(F.window(time_column, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time_column: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    return events.groupBy(F.session_window(time_column, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def ranked_batches(rows: DataFrame) -> DataFrame:
    return rows.withColumn("batch", F.dense_rank().over(W.orderBy("_offset")))
