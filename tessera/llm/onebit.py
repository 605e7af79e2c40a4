"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A base vector is turned by seeded random rotations, as many as give ``CODE_BITS`` signs, and
kept as the packed signs of its coordinates, with correction scalars: its norm, and for each
rotation the inner product between its direction and its code.  Codes and scalars are
made once a block, and rotations once a worker.  The inner product with a query is estimated
from packed bits: the rotated query is quantised to four bits, and its inner
product with a code is the sum of population counts of the code's bits under
each of the query's bit planes, averaged over the rotations; by the first rotations, where all rows
meet all queries, the same sums are made as one matrix product.  The estimate comes with an error bound
(``epsilon`` times the code's spread, plus the quantiser's step), so a vector is
reranked with exact double-precision products only if its upper bound reaches
the k-th largest lower bound.

Queries travel to the rows: a chunk of queries of bounded bytes is sent to every
task, the rows stay in their partition, and each task holds one block of rows
with its codes at a time.  A task keeps the k best of each query over its
blocks, so a block is pruned by what the blocks before it gave; the few left
of all tasks are merged by a window over the query.  Rotations are taken a few at a
time, and only rows that the first ones leave meet the others.  Queries above one
chunk make one pass over the rows for each chunk.  Every row is
indexed; the rotations depend on the number of dimensions and the seed alone.

Defined cases: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part; only vectors of equal length meet; a query's
own id is no candidate of it; repeated rows count once; ties go to the smaller
id; fewer candidates than k are all returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stash

#: Base vectors of a block, of a task's first one, and the bytes of its vectors.
BASE_BLOCK, FIRST_BLOCK, BLOCK_BYTES = 16384, 2048, 8 << 20
#: Queries of a chunk, the bytes of their vectors, and those rotated at once.
QUERY_BLOCK, QUERY_BYTES, GROUP = 1 << 16, 32 << 20, 128
#: Rows of a task, and of a batch it returns.
TASK_ROWS, OUT_ROWS = 1 << 17, 1 << 16
#: Spreads of an estimate's error that its bound covers.
EPSILON = 2.5
QUERY_BITS = 4
#: Signs of a code: one rotation of as many dimensions or more, else several.
CODE_BITS = 1024
#: Signs that all rows are estimated by, and then those that are left; so few rows are reranked at once.
FIRST_BITS, STEP_BITS, FEW = 256, (512, CODE_BITS), 1024
#: What estimates in single precision may be off by, of the lengths' product.
ROUNDING = 1e-5


@lru_cache(maxsize=4)
def rotations(dims: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrices ``(turns, dims, dims)``, the same for equal arguments."""
    made = []
    for turn in range(-(-CODE_BITS // dims)):
        q, r = np.linalg.qr(np.random.default_rng([seed, dims, turn]).standard_normal((dims, dims)))
        made.append(q * np.sign(np.diag(r)))
    return np.stack(made)


def _packed(signs: np.ndarray) -> np.ndarray:
    """``(..., dims)`` booleans as ``(..., words)`` of 64 bits."""
    dims = signs.shape[-1]
    padded = np.zeros((*signs.shape[:-1], -(-dims // 64) * 64), np.uint8)
    padded[..., :dims] = signs
    return np.packbits(padded, axis=-1).view(np.uint64)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


@dataclass
class Quantised:
    """The directions of queries, rotated and quantised to ``QUERY_BITS``."""

    level: np.ndarray  # (turns, n, dims) uint8
    masks: np.ndarray  # (turns, n, planes, words) uint64
    low: np.ndarray  # (turns, n)
    step: np.ndarray  # (turns, n)
    total: np.ndarray  # (turns, n) sum of the quantised coordinates
    length: np.ndarray  # (n,)

    @classmethod
    def build(cls, queries: np.ndarray, seed: int = 11) -> Quantised:
        length = _lengths(queries)
        turned = (queries / length[:, None]) @ rotations(queries.shape[1], seed)
        low = turned.min(axis=2)
        step = (turned.max(axis=2) - low) / (2**QUERY_BITS - 1)
        step[step == 0] = 1.0
        level = np.rint((turned - low[:, :, None]) / step[:, :, None]).astype(np.uint8)
        masks = _packed((level[:, :, None, :] >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None]) & 1)
        return cls(level, masks, low, step, step * level.sum(axis=2, dtype=np.int64) + low * queries.shape[1], length)


@dataclass
class Codes:
    """Packed one-bit codes of base vectors with their correction scalars."""

    bits: np.ndarray  # (turns, words, n) uint64
    norm: np.ndarray  # (n,) length of each vector
    align: np.ndarray  # (turns, n) inner product of its direction and its code
    dims: int

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Codes:
        dims = vectors.shape[1]
        norm = _lengths(vectors)
        unit = vectors / norm[:, None]
        bits, align = [], []
        for turn in rotations(dims, seed):
            turned = unit @ turn
            bits.append(np.ascontiguousarray(_packed(turned > 0).T))
            align.append(np.abs(turned).sum(axis=1) / math.sqrt(dims))
        return cls(np.stack(bits), norm, np.stack(align), dims)

    def __post_init__(self):
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64).astype(np.float32)
        alike = np.maximum(1 - self.align**2, 0) / max(self.dims - 1, 1) / self.align**2
        turns = np.arange(1, len(self.align) + 1)[:, None]
        # errors of the rotations are independent: their spreads add as squares
        self.spread = (np.cumsum(alike, axis=0) / turns**2).astype(np.float32)
        self.rest = (1 / np.minimum.accumulate(self.align, axis=0) ** 2 / turns).astype(np.float32)
        self.gain = (2 / (math.sqrt(self.dims) * self.align)).astype(np.float32)

    def of_direction(self, asked: Quantised, query: int, turns: int, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of directions by the first ``turns`` rotations, and their error bounds."""
        estimate = 0.0
        sums = np.uint16 if self.dims << QUERY_BITS < 1 << 16 else np.uint32
        for turn in range(turns):
            words = [word[rows] for word in self.bits[turn]]
            under = np.zeros(len(words[0]), sums)
            for plane in range(QUERY_BITS - 1, -1, -1):
                under <<= 1
                for word, mask in zip(words, asked.masks[turn, query, plane], strict=True):
                    under += np.bitwise_count(word & mask)
            # sum over set bits of the quantised query, less half the sum over all
            signed = under * np.float32(asked.step[turn, query])
            signed += self.ones[turn, rows] * np.float32(asked.low[turn, query]) - np.float32(asked.total[turn, query] / 2)
            estimate = estimate + signed * self.gain[turn, rows]
        # each coordinate is off by half a step at most and evenly so: a standard error of step / sqrt(12)
        quantised = np.float32(asked.step[:turns, query].max() ** 2 / 12)
        spread = np.sqrt(self.spread[turns - 1, rows] + quantised * self.rest[turns - 1, rows])
        return estimate / np.float32(turns), np.float32(EPSILON) * spread + np.float32(ROUNDING)

    def estimate(self, query: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with ``query`` by all rotations, and their error bounds."""
        asked = Quantised.build(query[None], seed)
        estimate, bound = self.of_direction(asked, 0, len(self.align), slice(None))
        return estimate * self.norm * asked.length[0], bound * self.norm * asked.length[0]


def _left(estimate: np.ndarray, bound: np.ndarray, norm: np.ndarray, own: np.ndarray | int | None, k: int, reach: float) -> np.ndarray:
    """The rows whose upper bound reaches ``reach``, or, where that is not known, the k-th largest lower bound."""
    if reach == -np.inf and len(norm) > k:
        low = (estimate - bound) * norm
        if own is not None:
            low[own] = -np.inf
        reach = np.partition(low, len(low) - k)[len(low) - k]
    keep = (estimate + bound) * norm >= reach
    if own is not None:
        keep[own] = False
    return np.flatnonzero(keep)


def survivors(codes: Codes, own: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """The rows whose upper bound reaches the k-th largest lower bound; those ``own`` take no part."""
    estimate, bound = codes.estimate(query)
    return _left(estimate, bound, np.ones(len(estimate)), own, k, -np.inf)


class Reach:
    """Upper bounds of a block's inner products with the directions of many queries, by the first rotations:
    the estimates are one matrix product of the codes' bits with the quantised queries."""

    def __init__(self, codes: Codes, turns: int):
        self.codes, self.turns = codes, turns
        self.most = codes.norm.max()
        self.norm = (codes.norm / self.most).astype(np.float32)
        n, wide = len(codes.norm), turns * codes.dims
        self.columns = np.empty((wide + 2 * turns + 1, n), np.float32)
        gain = codes.gain[:turns] / np.float32(turns) * self.norm
        for turn in range(turns):
            bits = np.unpackbits(np.ascontiguousarray(codes.bits[turn].T).view(np.uint8), axis=1, count=codes.dims)
            self.columns[turn * codes.dims : (turn + 1) * codes.dims] = bits.T * gain[turn]
        self.columns[wide : wide + turns] = gain * codes.ones[:turns]
        self.columns[wide + turns : -1] = gain

    def upper(self, asked: Quantised) -> np.ndarray:
        """``(queries, rows)``, as shares of the largest row's length."""
        turns, codes = self.turns, self.codes
        quantised = np.float32(asked.step[:turns].max() ** 2 / 12)
        spread = np.sqrt(codes.spread[turns - 1] + quantised * codes.rest[turns - 1])
        self.columns[-1] = (np.float32(EPSILON) * spread + np.float32(ROUNDING)) * self.norm
        coordinates = (asked.level[:turns] * asked.step[:turns, :, None]).transpose(1, 0, 2).reshape(len(asked.length), -1)
        query = np.concatenate((coordinates, asked.low[:turns].T, -asked.total[:turns].T / 2, np.ones((len(asked.length), 1))), axis=1)
        return query.astype(np.float32) @ self.columns

    def left(self, upper: np.ndarray, own: int | None, k: int, reach: float) -> np.ndarray:
        """The rows whose upper bound reaches ``reach``, or, where that is not known, the k-th largest lower bound."""
        if reach == -np.inf and len(upper) > k:
            low = upper - 2 * self.columns[-1]
            if own is not None:
                low[own] = -np.inf
            reach = np.partition(low, len(low) - k)[len(low) - k]
        else:
            reach /= self.most
        keep = upper >= np.float32(reach - ROUNDING * abs(reach))
        if own is not None:
            keep[own] = False
        return np.flatnonzero(keep)


def rerank(rows: np.ndarray, base: np.ndarray, codes: Codes, asked: Quantised, at: int, query: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of a block's ``rows`` that may be among the k best of a query, with exact scores; what is under ``reach`` can't be."""
    reach, taken = reach / asked.length[at], 0
    for bits in STEP_BITS:
        turns = min(max(1, bits // codes.dims), len(codes.align))
        if len(rows) <= FEW or turns == taken:
            break
        rows = rows[_left(*codes.of_direction(asked, at, turns, rows), codes.norm[rows], None, k, reach)]
        taken = turns
    return rows, (base[rows] * query).sum(axis=1)


class Best:
    """The k best of each query of one width over the blocks of a task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = np.zeros((len(ids), k), np.int64)
        self.scores = np.full((len(ids), k), -np.inf)
        self.n = np.zeros(len(ids), np.int64)

    def add(self, base_ids: np.ndarray, base: np.ndarray) -> None:
        """Take a block of rows of distinct, sorted ids."""
        codes, k = Codes.build(base), self.k
        first_turns = Reach(codes, min(max(1, FIRST_BITS // codes.dims), len(codes.align)))
        place = np.minimum(np.searchsorted(base_ids, self.ids), len(base_ids) - 1)
        own = np.where(base_ids[place] == self.ids, place, -1).tolist()
        for first in range(0, len(self.ids), GROUP):
            some = self.queries[first : first + GROUP]
            asked = Quantised.build(some)
            upper = first_turns.upper(asked)
            for i, query in enumerate(some):
                q = first + i
                n = int(self.n[q])
                reach = self.scores[q, k - 1] if n == k else -np.inf
                rows = first_turns.left(upper[i], own[q] if own[q] >= 0 else None, k, reach / asked.length[i])
                if not len(rows):
                    continue
                rows, scores = rerank(rows, base, codes, asked, i, query, k, reach)
                ids, scores = np.concatenate((self.found[q, :n], base_ids[rows])), np.concatenate((self.scores[q, :n], scores))
                order = np.lexsort((ids, -scores))[:k]
                self.n[q] = n = len(order)
                self.found[q, :n], self.scores[q, :n] = ids[order], scores[order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        step = max(1, OUT_ROWS // self.k)
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            have = np.arange(self.k) < self.n[part, None]
            cells = [np.repeat(self.ids[part], self.n[part]), self.found[part][have], self.scores[part][have]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "vec_id", "score"])


def usable(column: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_width(ids: pa.Array, lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ids and vectors of each width."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ids, ends = ids.to_numpy(), np.cumsum(sizes)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield dims, ids[at], flat[(ends[at, None] - dims + np.arange(dims)).ravel()].reshape(-1, dims)


def _firsts(ids: np.ndarray, last: int | None = None) -> np.ndarray:
    """Of sorted ids, the first places of each; ``last`` came before."""
    return np.flatnonzero(np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)


def _search(base: DataFrame, asked: DataFrame, k: int, base_block: int) -> DataFrame:
    """The k best of each row of ``asked``, which are few enough to be sent, in each partition of ``base``."""
    table = asked.toArrow().combine_chunks()
    chunk = {}
    if table.num_rows:
        ids, lists = (table.column(i).chunk(0) for i in range(2))
        for dims, q, v in _by_width(ids, lists):
            order = np.argsort(q, kind="stable")
            order = order[_firsts(q[order])]
            chunk[dims] = (q[order], v[order])
    shared = base.sparkSession.sparkContext.broadcast(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        held: dict[int, list] = {}
        last: dict[int, int] = {}
        next_size: dict[int, int] = {}  # blocks grow, so that few rows of each are left by those before it

        def size(dims: int) -> int:
            return max(1, min(base_block, BLOCK_BYTES // (8 * dims), next_size.get(dims, FIRST_BLOCK)))

        def take(dims: int, everything: bool) -> None:
            parts = held[dims]
            if not everything and sum(len(i) for i, _ in parts) < size(dims):
                return
            ids, vectors = (np.concatenate([part[c] for part in parts]) for c in range(2))
            at = 0
            while len(ids) - at >= (1 if everything else size(dims)):
                n = size(dims)
                best[dims].add(ids[at : at + n], vectors[at : at + n])
                next_size[dims] = 2 * n
                at += n
            held[dims] = [(ids[at:].copy(), vectors[at:].copy())] if at < len(ids) else []

        for batch in batches:
            for dims, ids, vectors in _by_width(batch.column(0), batch.column(1)):
                if dims not in shared.value:
                    continue
                once = _firsts(ids, last.get(dims))  # repeated rows count once
                if not len(once):
                    continue
                last[dims] = int(ids[-1])
                best.setdefault(dims, Best(*shared.value[dims], k))
                held.setdefault(dims, []).append((ids[once], vectors[once]))
                take(dims, False)
        for dims in list(best):
            if held[dims]:
                take(dims, True)
            yield from best.pop(dims).batches()

    found = base.mapInArrow(run, "query_id long, vec_id long, score double").repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, base_block: int = BASE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> the k nearest of each row that ``queries`` holds for.

    Returns ``(query_id, rank, vec_id, score)``.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("is_query")
    )
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.sum(F.when(F.col("is_query"), 8 * F.size("embedding") + 8))).first()
    n, n_queries, n_bytes = counts[0], counts[1], counts[2] or 0
    asked = rows.filter("is_query").select("vec_id", "embedding")
    # an id's rows stand together in one task, in one order whenever it runs
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    base = rows.select("vec_id", "embedding").repartition(tasks, "vec_id").sortWithinPartitions("vec_id")
    chunks = max(1, -(-n_queries // query_block), -(-n_bytes // QUERY_BYTES))
    if chunks == 1:
        return _search(base, asked, k, base_block)
    found = None
    for c in range(chunks):
        one = _search(base, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c), k, base_block)
        one = stash(one, "nearest")
        found = one if found is None else found.unionByName(one)
    return found
