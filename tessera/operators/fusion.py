"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rrf_fuse(ranked: DataFrame, k_rrf: int = 60) -> DataFrame:
    """``ranked(list_id, id, rank0)`` -> ``(id, score)``, best first.

    Only an id's first place in each list counts; it adds ``1 / (k_rrf + rank0 + 1)``.
    Ties stand in the order of the ids.
    """
    first = ranked.groupBy("list_id", "id").agg(F.min("rank0").alias("rank0"))
    fused = first.groupBy("id").agg(F.sum(1 / (F.lit(float(k_rrf)) + F.col("rank0") + 1)).alias("score"))
    return fused.orderBy(F.desc("score"), F.asc("id"))


def rrf_fuse_lists(lists: list[list[str]], k_rrf: int = 60) -> list[tuple[str, float]]:
    """The same for short lists held by the caller."""
    scores: dict[str, float] = {}
    for ranked in lists:
        seen = set()
        for rank0, key in enumerate(ranked):
            if key not in seen:
                seen.add(key)
                scores[key] = scores.get(key, 0.0) + 1 / (k_rrf + rank0 + 1)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))
