"""Point-in-time (as-of) join: each spine row gets at most one fact.

Both sides become one event stream and a running window carries the latest fact
forward, so there is one shuffle on the keys and no theta join.  With
``time_buckets`` the stream of a key is cut at global time quantiles: windows run
inside (key, bucket), and only the last fact of each bucket is carried on, so a
key that holds a large share of the rows is spread over tasks.

Contract: the spine is preserved; null keys and null times match nothing;
``boundary='exclusive'`` leaves out equal instants; ``tolerance`` is inclusive
and counts microseconds for timestamps, days for dates and steps for integers;
``nearest`` prefers the past at equal distance.  Facts of one key and instant are
an error in any group that the spine has, unless ``tie_break`` names a column
whose greatest value wins (nulls lose).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AsofError(ValueError):
    """A specification or input that the join can't take."""


class MissingByKey(AsofError):
    pass


class UnorderedTimeKey(AsofError):
    pass


class TimeKeyTypeMismatch(AsofError):
    pass


class AmbiguousMatch(AsofError):
    pass


@dataclass(frozen=True)
class AsofSpec:
    spine_by: Sequence[str]
    spine_time: str
    facts_by: Sequence[str]
    facts_time: str
    direction: str = "backward"
    boundary: str = "inclusive"
    tolerance: int | None = None
    tie_break: str | None = None
    project: Sequence[str] = field(default_factory=tuple)
    time_buckets: int = 0


ORDERED = (T.TimestampType, T.TimestampNTZType, T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _check(spine: DataFrame, facts: DataFrame, spec: AsofSpec) -> list[str]:
    if spec.direction not in ("backward", "forward", "nearest") or spec.boundary not in ("inclusive", "exclusive"):
        raise AsofError(f"direction {spec.direction}, boundary {spec.boundary}")
    if len(spec.spine_by) != len(spec.facts_by):
        raise MissingByKey("the sides have different numbers of keys")
    for df, names in ((spine, spec.spine_by), (facts, spec.facts_by)):
        for name in names:
            if name not in df.columns:
                raise MissingByKey(name)
    kinds = []
    for df, name in ((spine, spec.spine_time), (facts, spec.facts_time)):
        if name not in df.columns or not isinstance(df.schema[name].dataType, ORDERED):
            raise UnorderedTimeKey(name)
        kinds.append(df.schema[name].dataType)
    if kinds[0] != kinds[1]:
        raise TimeKeyTypeMismatch(f"{kinds[0].simpleString()} and {kinds[1].simpleString()}")
    project = list(spec.project) or [c for c in facts.columns if c not in (*spec.facts_by, spec.facts_time)]
    for name in project:
        if name not in facts.columns:
            raise AsofError(f"no fact column {name}")
    return project


def _ticks(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        # the session's zone must not move a zone-less time
        return F.unix_micros(F.to_timestamp_ltz(F.concat(column.cast("string"), F.lit("+00:00"))))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    return column.cast("long")


def asof_join(spine: DataFrame, facts: DataFrame, spec: AsofSpec) -> DataFrame:
    """Spine columns, then the projected fact columns, nullable."""
    project = _check(spine, facts, spec)
    kind = spine.schema[spec.spine_time].dataType
    keys = [f"__k{i}" for i in range(len(spec.spine_by))]
    left = spine.select(*(F.col(c).alias(k) for c, k in zip(spec.spine_by, keys, strict=True)), F.col(spec.spine_time).alias("__t"), F.struct(*(F.col(f"`{c}`") for c in spine.columns)).alias("__row"))
    facts_struct = F.struct(F.col(spec.facts_time).alias("__ft"), F.lit(True).alias("__hit"), *(F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(project)))
    tie = [F.col(spec.tie_break).alias("__tie")] if spec.tie_break else []
    right = facts.select(*(F.col(c).alias(k) for c, k in zip(spec.facts_by, keys, strict=True)), F.col(spec.facts_time).alias("__t"), facts_struct.alias("__fact"), *tie)
    for k in [*keys, "__t"]:
        right = right.filter(F.col(k).isNotNull())
    fine = F.col("__t").isNotNull()
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    right = _settle_ties(left, right, keys, spec)
    bounds = _bounds(left, right, spec.time_buckets) if spec.time_buckets > 1 else []
    live, idle = left.filter(fine), left.filter(~fine)
    if spec.direction == "nearest":
        back = _carry(live, right, keys, kind, "backward", spec.boundary, bounds, "__back")
        both = _carry(back, right, keys, kind, "forward", spec.boundary, bounds, "__ahead")
        now, b, a = _ticks(F.col("__t"), kind), _ticks(F.col("__back.__ft"), kind), _ticks(F.col("__ahead.__ft"), kind)
        pick = F.when(F.col("__ahead").isNull() | (now - b <= a - now), F.col("__back")).otherwise(F.col("__ahead"))
        found = both.withColumn("__fact", pick).drop("__back", "__ahead")
    else:
        found = _carry(live, right, keys, kind, spec.direction, spec.boundary, bounds, "__fact")
    if spec.tolerance is not None:
        far = F.abs(_ticks(F.col("__t"), kind) - _ticks(F.col("__fact.__ft"), kind)) > spec.tolerance
        found = found.withColumn("__fact", F.when(far, None).otherwise(F.col("__fact")))
    idle = idle.withColumn("__fact", F.lit(None).cast(right.schema["__fact"].dataType))
    out = found.select("__row", "__fact").unionByName(idle.select("__row", "__fact"))
    return out.select("__row.*", *(F.col(f"__fact.__p{i}").alias(c) for i, c in enumerate(project)))


def _settle_ties(left: DataFrame, right: DataFrame, keys: list[str], spec: AsofSpec) -> DataFrame:
    if spec.tie_break:
        best = F.max_by("__fact", F.struct(F.col("__tie").isNotNull(), F.col("__tie"))).alias("__fact")
        return right.groupBy(*keys, "__t").agg(best)
    held = right.join(left.select(*keys).distinct(), keys, "left_semi") if keys else right
    twice = held.groupBy(*keys, "__t").count().filter("count > 1").limit(1).collect()
    if twice:
        raise AmbiguousMatch(f"facts share key and instant: {twice[0].asDict()}")
    return right


def _bounds(left: DataFrame, right: DataFrame, buckets: int) -> list:
    times = left.select("__t").unionByName(right.select("__t")).filter("__t is not null")
    order = _ticks(F.col("__t"), times.schema["__t"].dataType)
    shares = [i / buckets for i in range(1, buckets)]
    got = times.select(order.alias("x")).agg(F.percentile_approx("x", shares, 1000)).first()[0]
    return sorted(set(got or []))


def _carry(live: DataFrame, right: DataFrame, keys: list[str], kind: T.DataType, direction: str, boundary: str, bounds: list, name: str) -> DataFrame:
    """``live`` with the latest fact in running order as ``name``."""
    sign = 1 if direction == "backward" else -1
    facts_first = boundary == "inclusive"
    nothing = F.lit(None).cast(right.schema["__fact"].dataType)
    extra = [c for c in live.columns if c not in (*keys, "__t", "__row")]
    spine_row = F.struct("__row", *extra)
    events = live.select(*keys, "__t", F.lit(int(facts_first)).alias("__side"), spine_row.alias("__s"), nothing.alias("__f"))
    events = events.unionByName(right.select(*keys, "__t", F.lit(int(not facts_first)).alias("__side"), F.lit(None).cast(events.schema["__s"].dataType).alias("__s"), F.col("__fact").alias("__f")))
    order = [F.asc("__t") if sign > 0 else F.desc("__t"), F.asc("__side")]
    group: list = list(keys)
    if bounds:
        tick = _ticks(F.col("__t"), kind)
        events = events.withColumn("__b", sum(((tick >= b).cast("int") for b in bounds), F.lit(0)) * sign)
        group.append("__b")
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    running = F.last("__f", ignorenulls=True).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = events.withColumn(name, running).filter(F.col("__s").isNotNull())
    if bounds:
        time_order = F.col("__t") if sign > 0 else F.struct((-_ticks(F.col("__t"), kind)).alias("n"))
        last = events.filter(F.col("__f").isNotNull()).groupBy(*group).agg(F.max_by("__f", time_order).alias("__carried"))
        known = events.select(*group).distinct().join(last, group, "left")
        before = F.last("__carried", ignorenulls=True).over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
        known = known.select(*group, before.alias("__carried"))
        found = found.join(known, group).withColumn(name, F.coalesce(name, "__carried")).drop("__carried")
    return found.select(*keys, "__t", "__s.*", name)
