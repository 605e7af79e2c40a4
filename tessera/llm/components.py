"""Connected components by alternating large-star and small-star rounds.

Every round is two joins over the edge table, written to the shared folder.
Neighbour minima are partial aggregates, so a node with very many neighbours
is summed map-side and its edges are split by adaptive skew joins; neighbour
lists are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(node, root)``: the least id reachable.

    Self-loops, repeated and null-ended edges are ignored; nodes without an edge
    are absent; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    now = stash(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
        after = stash(_small_star(_large_star(now).distinct()).filter("u <> v").distinct(), "edges")
        drop_path(spark, now.stash_path)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
