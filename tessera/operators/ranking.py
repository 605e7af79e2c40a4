"""Positions over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.cut import cut

ROW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their position from 0 in the given order as ``name``.

    Rows are range-partitioned and sorted, and numbered inside their partition; the counts of the
    partitions before it, one row each, are added.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # cut, so that both readings see one layout
    laid = cut(laid.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(ROW)))
    sizes = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # at most n rows
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    return laid.join(starts, "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
