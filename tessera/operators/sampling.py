"""Seeded walks for training pairs: SplitMix64 streams, one for each start node."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = ((h ^ byte) * 0x100000001B3) & MASK
    return h


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def unit(self) -> float:
        return (self.next() >> 11) / float(1 << 53)


def seed_for(key: str, seed: int) -> int:
    return SplitMix64(fnv1a(key) ^ (seed & MASK)).next()


def walk_pairs(edges: DataFrame, walks: int = 4, length: int = 4, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """node2vec pairs ``(anchor, positive)``: the distinct nodes of each node's biased walks.

    Walks advance hop by hop for all nodes at once: a walk's choice among the
    neighbours of its node is the neighbour with the least weighted hash of (walk,
    hop, neighbour), an exponential race with the biases 1/p (back), 1 (a neighbour of
    the previous node) and 1/q (elsewhere), so no adjacency list is gathered.
    """
    adjacent = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    adjacent = adjacent.unionByName(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    walkers = adjacent.select(F.col("a").alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w"))
    now = walkers.select("start", "w", F.col("start").alias("at"), F.lit(None).cast("string").alias("before"))
    visited = None
    for hop in range(length):
        options = now.join(adjacent, now["at"] == adjacent["a"]).select("start", "w", "at", "before", F.col("b").alias("to"))
        close = adjacent.select(F.col("a").alias("before"), F.col("b").alias("to"), F.lit(True).alias("close"))
        options = options.join(close, ["before", "to"], "left")
        bias = F.when(F.col("before").isNull(), 1.0).when(F.col("to") == F.col("before"), 1 / p).when(F.col("close"), 1.0).otherwise(1 / q)
        unit = (F.shiftrightunsigned(F.xxhash64("start", "w", F.lit(hop), "to", F.lit(seed)), 11) + 1) / float(1 << 53)
        options = options.withColumn("race", -F.log(unit) / bias)
        now = options.groupBy("start", "w").agg(F.min_by(F.struct("to", "at"), F.struct("race", "to")).alias("m")).select("start", "w", F.col("m.to").alias("at"), F.col("m.at").alias("before"))
        step = now.select(F.col("start").alias("anchor"), F.col("at").alias("positive"))
        visited = step if visited is None else visited.unionByName(step)
    return visited.filter("anchor <> positive").distinct()


def fanout_sample(neighbours: DataFrame, fanout: int, seed: int) -> DataFrame:
    """``neighbours(node, list)`` -> ``(node, sample)``: a seeded partial Fisher-Yates over each sorted list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, items in zip(frame["node"], frame["list"], strict=True):
                items, rng = sorted(items), SplitMix64(seed_for(node, seed))
                for i in range(min(fanout, len(items))):
                    j = i + rng.next() % (len(items) - i)
                    items[i], items[j] = items[j], items[i]
                out.append(items[:fanout])
            yield pd.DataFrame({"node": frame["node"], "sample": out})

    return neighbours.mapInPandas(run, "node string, sample array<string>")
