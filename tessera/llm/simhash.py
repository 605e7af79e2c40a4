"""SimHash near-duplicate classes, searched with sharded BK-trees.

A document's words are the runs of bytes outside 0x20 and 0x09-0x0D of its
text with A-Z lower-cased; its shingles are ``words`` consecutive words joined
by spaces, repeats included (fewer words: the whole sequence; none: an all-zero
fingerprint).  Bit i of the fingerprint is one if it is set in over half of the
shingles' hashes: XXH64 with seed 42, and for fingerprints wider than 64 bits
further lanes mixed from it.

Distinct fingerprints are dealt to shards by keys that any two fingerprints
within the radius share: with ``exact`` shards the bits are cut into
``radius + agree`` blocks and every choice of ``agree`` of them is a key, so by
the pigeonhole principle no pair within the radius is lost.  Wide fingerprints
with a large radius are sharded by other keys (see ``neardup``).
A shard's fingerprints form one BK-tree whose children are keyed by their
integer Hamming distance to the parent; a search follows only the edges within
the radius of its own distance.  Many small trees are grown and searched level
by level in one set of arrays.  A shard above ``piece`` fingerprints is cut into
pieces: a piece is searched against its own tree once, and against the tree of
each piece before it, so what is sent to a task is bounded, no two fingerprints
meet twice, and no link is lost.

A shard emits a spanning forest of its links; components of all of them are
found with distributed star rounds.

Defined cases: a null text is an empty one; empty texts link like any others;
rows with a null id get their fingerprint and a null component; repeated rows
and ids count once; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, empty_text, stash
from tessera.llm.components import components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words of 64 bits in a search frontier held at once.
FRONTIER = 1 << 19
#: Rows gathered before a set of shards is searched.
GATHER = 1 << 17
#: A row's part in its shard: in the tree and searched, searched alone, in the tree alone.
BOTH, ASKED, HELD = 0, 1, 2


@dataclass(frozen=True)
class SimHash:
    """Settings: shingle words, fingerprint lanes of 64 bits, and the radius.

    ``agree`` sets how many blocks of bits a shard key has.
    """

    words: int = 4
    lanes: int = 1
    radius: int = 4
    agree: int = 2
    piece: int = 8192

    @property
    def bits(self) -> int:
        return 64 * self.lanes


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of UTF-8 ``data``, repeats included."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(parts) - words + 1)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    if lane == 0:
        return h
    z = h + np.uint64((int(GOLDEN) * lane) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(data: bytes, words: int = 4, lanes: int = 1) -> bytes:
    """The SimHash of UTF-8 ``data``: ``8 * lanes`` big-endian bytes."""
    h = shingle_hashes(data, words)
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            part = _lane(h[at : at + 65536], lane).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, conf: SimHash) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs``."""
    words, lanes = conf.words, conf.lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), words, lanes) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def _matrix(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    return _lane(x ^ np.uint64(salt), 1 + salt % 7)


def shard_keys(fps: np.ndarray, conf: SimHash) -> np.ndarray:
    """A row of keys for each fingerprint; any pair within the radius shares one."""
    assert conf.lanes == 1, "shards of blocks are made for fingerprints of 64 bits"
    columns = []
    blocks = conf.radius + conf.agree
    edges = [64 * b // blocks for b in range(blocks + 1)]
    parts = [(fps[:, 0] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    for n, chosen in enumerate(combinations(range(blocks), conf.agree)):
        value = np.zeros(len(fps), np.uint64)
        for b in chosen:
            value = (value << np.uint64(edges[b + 1] - edges[b])) | parts[b]
        columns.append(_mix(value, n + 1))
    return np.stack(columns, axis=1).view(np.int64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over the runs of ``shard`` (sorted), as arrays.

    Growing is level by level: of the rows that stand at one node, the first of
    each distance becomes the child on that edge and the others move to it, as
    one insertion after another would have it.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps, self.width = fps, 64 * fps.shape[1] + 1
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        keys, nodes = [], []
        at, cur = np.flatnonzero(~first), self.root[~first]
        while len(at):
            key = cur * self.width + _distance(fps[at], fps[cur])
            order = np.lexsort((at, key))
            at, key = at[order], key[order]
            lead = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[lead])
            nodes.append(at[lead])
            child = at[lead][np.cumsum(lead) - 1]
            at, cur = at[~lead], child[~lead]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], node[order]

    def links(self, fps: np.ndarray, root: np.ndarray, before: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a place in ``fps`` and a row of the tree at ``root`` within the radius,
        of rows before ``before`` alone."""
        most = max(FRONTIER // self.fps.shape[1], 1)
        # with counts, ``node`` is the place of the first of so many children, which are not spread out yet
        stack = [(np.arange(len(fps)), root, None)]
        while stack:
            query, node, n = stack.pop()
            if n is not None:
                cut = max(1, int(np.searchsorted(np.cumsum(n), most, "right")))
                if cut < len(n):
                    stack.append((query[cut:], node[cut:], n[cut:]))
                query, node, n = query[:cut], node[:cut], n[:cut]
                at = np.repeat(node - (np.cumsum(n) - n), n) + np.arange(n.sum())
                query, node = np.repeat(query, n), self.node[at]
            elif len(query) > most:
                half = len(query) // 2
                stack += [(query[:half], node[:half], None), (query[half:], node[half:], None)]
                continue
            keep = node < before[query]  # a child comes after its parent
            query, node = query[keep], node[keep]
            if not len(query):
                continue
            d = _distance(fps[query], self.fps[node])
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.key, node * self.width + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * self.width + np.minimum(d + radius, self.width - 1), "right")
            n = high - low
            some = np.flatnonzero(n)
            if len(some):
                stack.append((query[some], low[some], n[some]))


def shard_links(key: np.ndarray, part: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius in all shards of ``key`` (sorted runs); ``part`` is a row's part in its shard."""
    held = np.flatnonzero(part != ASKED)
    forest = Forest(fps[held], key[held])
    asked = np.flatnonzero(part != HELD)
    at = np.searchsorted(key[held], key[asked])  # the first row of the shard's tree
    some = at < len(held)
    some[some] &= key[held][at[some]] == key[asked][some]
    # a row of the tree meets the rows before it; one that only asks meets all
    before = np.where(part[asked] == BOTH, np.searchsorted(held, asked), len(held))
    some &= before > at
    asked, at, before = asked[some], at[some], before[some]
    step = 1 << 14
    for i in range(0, len(asked), step):
        rows = asked[i : i + step]
        for q, n in forest.links(fps[rows], at[i : i + step], before[i : i + step], radius):
            yield rows[q], held[n]


def _labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each row is linked to, over all pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            if not (la != lb).any():
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def spanning_links(key: np.ndarray, node: np.ndarray, part: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all shards in ``key`` (sorted runs), reduced to a spanning forest."""
    label = _labels(len(key), shard_links(key, part, fps, radius))
    tied = np.flatnonzero(label != np.arange(len(key)))
    return node[tied], node[label[tied]]


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that none of its values goes over a cut."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHER:
            all_ = joined()
            keys = all_.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
            if cut:
                yield all_.slice(0, cut)
            held = [all_.slice(cut)]
            rows = held[0].num_rows
    if held:
        yield joined()


def split_shards(rows: DataFrame, piece: int) -> DataFrame:
    """``rows(key, node, ...)`` with their ``part``; shards above ``piece`` rows are cut into
    pieces, each its own tree, and each asked for once by every piece after it."""
    hot = stash(
        rows.groupBy("key").count().filter(F.col("count") > piece)
        .select("key", F.ceil(F.col("count") / piece).cast("int").alias("pieces")),
        "hot",
    )
    whole = rows.withColumn("part", F.lit(BOTH))
    n_hot = hot.count()
    if not n_hot:
        return whole
    hot = F.broadcast(hot) if n_hot * 24 <= BROADCAST_BYTES else hot
    rest = [c for c in rows.columns if c != "key"]
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    part = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), HELD).otherwise(ASKED)
    split = (
        rows.join(hot, "key").select("key", *rest, "pieces", own.alias("own")).select("key", *rest, "own", other.alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *rest, part.alias("part"))
    )
    return whole.join(hot, "key", "left_anti").unionByName(split)


def dealt_by_key(rows: DataFrame, *order: str) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "key").sortWithinPartitions("key", *order)


def near_links(distinct: DataFrame, conf: SimHash) -> DataFrame:
    """``distinct(node, fp)`` -> links ``(u, v)`` that span all pairs within the radius."""
    lanes, radius = conf.lanes, conf.radius

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                keys = shard_keys(_matrix(some.column(1), lanes), conf)
                index = pa.array(np.repeat(np.arange(some.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), some.column(0).take(index), some.column(1).take(index)], ["key", "node", "fp"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_shards(batches):
            key, node, part = (batch.column(i).to_numpy() for i in range(3))
            u, v = spanning_links(key, node, part, _matrix(batch.column(3), lanes), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = distinct.select("node", "fp").filter("node is not null").mapInArrow(deal, "key long, node long, fp binary")
    rows = split_shards(stash(rows, "shards"), conf.piece)
    return dealt_by_key(rows.select("key", "node", "part", "fp"), "node").mapInArrow(search, "u long, v long").distinct()


def near_classes(docs: DataFrame, conf: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, a row for each row."""
    fps = stash(fingerprints(docs, conf), "fingerprints")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    roots = components(near_links(distinct, conf))
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    named = stash(named, "classes")
    return fps.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id")
    )
