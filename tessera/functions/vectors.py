"""Vector expressions and aggregates over ``array<float|double>`` columns.

Everything accumulates in double precision inside the JVM.  The element-wise
aggregates explode (group, position, value) rows, so they combine map-side and a
group of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Denominators below this count as zero (single-precision machine epsilon).
TINY = 1.1920929e-07


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where a norm is (nearly) zero."""
    scale = norm(a) * norm(b)
    return F.when(scale < TINY, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; 1 where a norm is (nearly) zero."""
    scale = norm(a) * norm(b)
    return F.when(scale < TINY, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def l2_normalise(v: Column) -> Column:
    """Unit length; an all-zero vector stays."""
    length = norm(v)
    return F.when(length == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / length))


def sign_bits(v: Column, thresholds: Column | None = None) -> Column:
    """A string of 0 and 1: whether each lane exceeds its threshold (default 0)."""
    over = F.zip_with(_doubles(v), _doubles(thresholds), lambda x, t: x > t) if thresholds is not None else F.transform(_doubles(v), lambda x: x > 0)
    return F.array_join(F.transform(over, lambda b: b.cast("int").cast("string")), "")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two bit strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def require_vector(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{column} is {kind.simpleString()}; vector aggregates take arrays of floating-point numbers")


AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max}


def vector_aggregate(df: DataFrame, keys: Sequence[str], column: str, how: str, alias: str | None = None) -> DataFrame:
    """Element-wise ``sum``, ``mean`` or ``max`` of each group, as ``array<float>``.

    Null vectors are skipped; a group without any vector gets null; unequal widths
    within a group raise when the result is computed.
    """
    require_vector(df, column)
    alias = alias or f"vector_{how}"
    keys = list(keys)
    lanes = df.select(*keys, F.size(column).alias("__w"), F.posexplode(_doubles(F.col(column))).alias("__p", "__x"))
    lanes = lanes.groupBy(*keys, "__p").agg(AGGREGATES[how]("__x").alias("__x"), F.min("__w").alias("__lo"), F.max("__w").alias("__hi"))
    same = F.when(F.max("__hi") == F.min("__lo"), F.lit(0.0)).otherwise(F.raise_error(F.lit("vectors of unequal width in a group")).cast("double"))
    made = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__p", "__x"))).alias("__v"), same.alias("__ok"))
    made = made.select(*keys, F.transform("__v", lambda e: (e["__x"] + F.col("__ok")).cast("float")).alias(alias))
    groups = df.select(*keys).distinct() if keys else None
    if groups is None:
        return made if keys else df.sparkSession.range(1).select().join(made, how="left")
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return groups.alias("g").join(made.alias("m"), on, "left").select(*(F.col(f"g.{k}") for k in keys), F.col(f"m.{alias}"))


def fold_in_order(vectors: Column, width: Column, order: str = "rank") -> Column:
    """Sum of ``array<struct<rank, v>>`` in a fixed order: the same bits whatever the partitioning."""
    zeros = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    return F.aggregate(F.array_sort(vectors), zeros, lambda acc, e: F.zip_with(acc, _doubles(e["v"]), lambda x, y: x + y))
