"""Minimax contiguous sharding under the law ``bytes``.

Documents with equal texts form an atomic group; groups stand in the order of
their least ``doc_id``.  The shards are contiguous runs of groups, and the
greatest shard is as small as it can be: the capacity is found by binary search,
each probe being checked greedily from one cut to the next.

The order is laid out by a range partitioning on (group, document) with running
sums inside each partition, so a group of any size spans partitions.  A probe
never sees all group ends: the driver holds at most ``cells`` of them, the last
group end of each byte range.  A probe that may only cut at ends it holds gives
a capacity that surely suffices, one that may cut anywhere gives one that surely
does not; while the two differ, the ends inside the ranges that cuts between the
two could fall into are fetched in finer ranges.  The result is the exact
minimum at any number of groups.

If large groups leave shards without rows, the largest remaining runs are cut
near their middles until every shard has a group or each group its shard.

Defined cases: a null text has no bytes and equals the empty text; a row's size
is its text's UTF-8 bytes plus ``overhead``; rows with equal or null ids are
rows of their own (null ids come first); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import empty_text, stash

#: Group ends that the driver holds for one refinement at most.
CELLS = 32768


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        ends = np.cumsum(batch.column("size").to_numpy()) + total
        more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(ends)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "row", "end"])
        rows, total = rows + n, int(ends[-1]) if n else total


class Ends:
    """The group ends known so far, and the byte ranges inside which others may lie."""

    def __init__(self, total: int, fetch: Callable[[list[tuple[int, int]], int], list[tuple[int, int, int]]], cells: int):
        self.total, self.fetch, self.cells = total, fetch, cells
        self.known: list[int] = [0]
        #: open ranges (low, high): group ends may lie strictly between two neighbouring known ends
        self.open: dict[int, int] = {}
        self.refine([(0, total)])

    def refine(self, spans: list[tuple[int, int]]) -> None:
        """Fetch the last end and the count of ends in finer ranges of ``spans`` (low, high]."""
        width = max(1, -(-sum(b - a for a, b in spans) // self.cells))
        for a, _ in spans:
            self.open.pop(a, None)
        found = self.fetch(spans, width)
        self.known = sorted({*self.known, *(last for _, last, _ in found), *(first for first, _, _ in found)})
        for first, last, n in found:
            if n > 2:
                # ends strictly between the first and the last of the range are not known
                self.open[first] = last

    def below(self, x: int, surely: bool) -> int:
        """The last group end at or below ``x``: a known one, or the most it could be."""
        at = self.known[bisect_right(self.known, x) - 1]
        return at if surely or at not in self.open else x

    def span(self, x: int) -> tuple[int, int] | None:
        at = self.known[bisect_right(self.known, x) - 1]
        return (at, self.open[at]) if at in self.open and x > at else None


def _cuts(ends: Ends, capacity: int, shards: int, surely: bool) -> list[int] | None:
    """Greedy cuts; None if the shards do not hold everything."""
    at, cuts = 0, []
    for _ in range(shards):
        after = ends.below(min(at + capacity, ends.total), surely)
        if after <= at:
            return None
        cuts.append(after)
        at = after
        if at >= ends.total:
            return cuts
    return None


def minimax_cuts(ends: Ends, shards: int) -> list[int]:
    """The ends of the runs under the least feasible capacity."""
    if not ends.total:
        return []

    def least(surely: bool) -> int:
        low, high = -(-ends.total // shards), ends.total
        while low < high:
            mid = (low + high) // 2
            if _cuts(ends, mid, shards, surely) is None:
                low = mid + 1
            else:
                high = mid
        return low

    while True:
        high, low = least(True), least(False)
        if low >= high:
            return _cuts(ends, high, shards, True)
        # every cut of a capacity between the two lies between the earliest and the latest
        spans, early, late = set(), 0, 0
        for _ in range(shards):
            early_next, late_next = min(early + low, ends.total), min(late + high, ends.total)
            at = max(bisect_right(ends.known, early_next) - 1, 0)
            while at < len(ends.known) and ends.known[at] <= late_next:
                if ends.known[at] in ends.open:
                    spans.add((ends.known[at], ends.open[ends.known[at]]))
                at += 1
            early, late = ends.below(early_next, True), late_next
            if early >= ends.total:
                break
        ends.refine(sorted(spans))


def fill(cuts: list[int], ends: Ends, shards: int) -> list[int]:
    """Further cuts of the largest runs, near their middles, until there are enough runs."""
    heap = [(a - b, a, b) for a, b in zip([0, *cuts], cuts, strict=False)]
    heapq.heapify(heap)
    done: list[int] = []
    while heap and len(heap) + len(done) < shards:
        _, a, b = heapq.heappop(heap)
        low, high = bisect_right(ends.known, a), bisect_left(ends.known, b)
        inner = ends.known[low:high]
        if not inner and a in ends.open:
            ends.refine([(a, b)])
            inner = ends.known[bisect_right(ends.known, a) : bisect_left(ends.known, b)]
        if not inner:
            done.append(b)
            continue
        middle = min(inner, key=lambda x: abs(2 * x - a - b))
        for pair in ((a, middle), (middle, b)):
            heapq.heappush(heap, (pair[0] - pair[1], *pair))
    return sorted({*done, *(b for _, _, b in heap)})


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, cells: int = CELLS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row."""
    spark = docs.sparkSession
    raw = empty_text("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"),
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = rows.join(first, "digest")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["first", "digest", "doc_id"]
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = "digest binary, doc_id long, size long, text_crc32 long, first long, part int, row long, end long"
    laid = stash(laid.mapInArrow(_running, schema), "laid")
    parts = laid.groupBy("part").agg(F.max("row").alias("rows"), F.max("end").alias("bytes")).orderBy("part").collect()
    if not parts:
        return _result(laid.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")))
    base_bytes, total = {}, 0
    base_rows, count = {}, 0
    for p in parts:  # one row a partition
        base_bytes[p["part"]], base_rows[p["part"]] = total, count
        total, count = total + p["bytes"], count + p["rows"] + 1
    bases = F.broadcast(spark.createDataFrame([(k, base_bytes[k], base_rows[k]) for k in base_bytes], "part int, b long, r long"))
    laid = laid.join(bases, "part").select(
        "doc_id", "size", "text_crc32", "first", "digest",
        (F.col("end") + F.col("b")).alias("end"), (F.col("row") + F.col("r")).alias("row"),
    )
    groups = laid.groupBy("first", "digest").agg(F.max("end").alias("end")).select("end")

    def fetch(spans: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
        # at most one row a shard and refinement; the spans don't overlap, so an end has one
        table = F.broadcast(spark.createDataFrame(spans, "low long, high long"))
        chosen = groups.join(table, (F.col("end") > F.col("low")) & (F.col("end") <= F.col("high")))
        cell = F.expr(f"(end - low - 1) div {width}L")
        found = chosen.groupBy("low", cell.alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n"))
        return [(r["a"], r["b"], r["n"]) for r in found.collect()]  # ``cells`` and one a span at most

    ends = Ends(total, fetch, cells)
    cuts = fill(minimax_cuts(ends, shards), ends, shards)
    start = F.col("end") - F.col("size")
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (start >= cut).cast("int")
    laid = laid.withColumn("shard", shard)
    counts = {r["shard"]: r["count"] for r in laid.groupBy("shard").count().collect()}  # a row a shard
    before, bases = 0, []
    for k in sorted(counts):
        bases.append((k, before))
        before += counts[k]
    laid = laid.join(F.broadcast(spark.createDataFrame(bases, "shard int, zero long")), "shard")
    return _result(laid.withColumn("slot", F.col("row") - F.col("zero")))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
