"""Near-duplicate removal: SimHash BK-trees over rare-shingle shards, decided by exact similarity.

Two texts are near duplicates if their sets of five-word shingles have a Jaccard
similarity of ``similarity`` or more; classes are the components of such pairs.

1. Texts with equal shingle sets are copies of one; they count once from here on.
2. Shards.  Every text is dealt to the shards of its rarest shingles, so many that
   two sets of the similarity must share one of them under any one order of all
   shingles (a prefix filter).  The order puts frequent shingles last; it comes
   from counts over all texts and changes the work, never the result.
3. Trees.  A text carries a SimHash of 128 bits of its shingle set.  At similarity
   0.8 each bit differs with a probability of 0.15 (0.19 for the smallest sets), so
   the radius of 48 lies over five standard deviations beyond the mean: a pair at the
   very limit is lost with a probability below one in a million, and unrelated
   texts mostly stay outside.  In a shard a text is first held against the shard's
   first one; shards whose texts are in one class are done with; the first texts
   of a shard's classes then meet its least one; what is still apart meets
   in BK-trees over the shard, cut into pieces of bounded size.  A map of parity bits
   bounds from below in how many shingles two sets differ, so most pairs within the
   radius that are not near need no texts; no near pair is lost by it.
4. Every pair that is left is decided by the exact similarity of its two
   sets.  The texts of a pair travel to it; a text that very many pairs share is
   sent to several tasks.

The settings are the same at every size.  Nothing is gathered on the driver but
the counts of ``COMMON`` frequent shingles.

Defined cases: a null text is an empty one; texts without words are copies of each
other; rows with a null id stay; of rows with one id and one text the least stays;
rows with one id and different texts are different documents; an empty table gives
an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, empty_text, small, stash
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingle_sets
from tessera.llm.simhash import dealt_by_key, shard_links, split_shards, whole_shards

WORDS, SIMILARITY, RADIUS = 5, 0.8, 48
#: Shingles whose frequency is told to the tasks, and those gathered before a task counts.
COMMON, CHUNK = 1 << 17, 1 << 20
#: Texts of a chunk that make a shingle frequent, and pairs that share one sent text.
FREQUENT, FAN = 8, 256
#: Rows of a shard's piece.
PIECE = 8192
#: Texts hashed at once.
TEXTS = 128


def simhash128(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set of hashes, as rows of two words of 64 bits."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        counts = np.zeros(128, np.int64)
        for at in range(0, len(s), 16384):
            part = s[at : at + 16384]
            lanes = np.stack((mix(part ^ np.uint64(0xA0761D6478BD642F)), mix(part ^ np.uint64(0xE7037ED1A0B428DB))), axis=1)
            counts += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * counts > len(s)).view(np.uint64)
    return out


def parity_bits(s: np.ndarray) -> bytes:
    """A map of bits, each telling whether an odd number of the set's hashes fall on it.  Two maps
    differ in at most as many bits as the sets do in shingles; its size follows the set's."""
    m = max(64, 1 << int(1.5 * len(s)).bit_length())
    at = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8)).tobytes()


def may_be_similar(bits: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the maps of the sets ``a`` and ``b`` leave room for the similarity; true for all pairs that have it."""
    keep = np.zeros(len(a), bool)
    width = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    place = np.zeros(len(bits), np.int64)
    maps = {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        place[rows] = np.arange(len(rows))
        maps[w] = np.frombuffer(b"".join(bits[i] for i in rows.tolist()), np.uint64).reshape(-1, w)

    def folded(rows: np.ndarray, w: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(maps[w][place[rows]].reshape(len(rows), w // to, to), axis=1)

    for w in maps:
        for v in maps:
            pairs = np.flatnonzero((width[a] == w) & (width[b] == v))
            for at in range(0, len(pairs), 1 << 14):
                p = pairs[at : at + (1 << 14)]
                to = min(w, v)
                differ = np.bitwise_count(folded(a[p], w, to) ^ folded(b[p], v, to)).sum(axis=1, dtype=np.int64)
                keep[p] = differ <= (1 - similarity) / (1 + similarity) * (n[a[p]] + n[b[p]]) + 1e-6
    return keep


def prefix_size(n: int, similarity: float) -> int:
    """How many of the rarest of ``n`` shingles a text's shards come from."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at in range(0, len(column), TEXTS):
        yield at, list(shingle_sets(column.slice(at, TEXTS).to_pylist(), WORDS))


def _contents(rows: DataFrame) -> DataFrame:
    """``rows(node, text)`` -> ``(node, key, bits)``, the key telling shingle sets apart, and
    ``(h, seen)``: how many texts of a task's chunk hold a shingle that is frequent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["node", "key", "bits", "h", "seen"], [], 0

        def counted() -> pa.RecordBatch:
            h, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= FREQUENT
            none = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(none, pa.int64()), *(pa.nulls(none, pa.binary()),) * 2, pa.array(h[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], names
            )

        for batch in batches:
            keys, bits = [], []
            for _, sets in _sets(batch.column(1)):
                bits += map(parity_bits, sets)
                keys += [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                held += sets
                n += sum(map(len, sets))
                if n > CHUNK:
                    yield counted()
                    held, n = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), none, none], names)
        if held:
            yield counted()

    return rows.mapInArrow(run, "node long, key binary, bits binary, h long, seen long")


def _common(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, at most ``COMMON``."""
    counts = made.filter("h is not null").groupBy("h").agg(F.sum("seen").alias("seen"))
    table = counts.orderBy(F.desc("seen"), "h").limit(COMMON).toArrow()
    h, seen = table["h"].to_numpy().view(np.uint64), table["seen"].to_numpy()
    order = np.argsort(h)
    return h[order], seen[order]


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """``(key, node, f1, f2, n)``: a row for each shingle of a set's prefix, the rarest first."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value
        for batch in batches:
            for at, sets in _sets(batch.column(1)):
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                text = np.repeat(np.arange(len(sets)), size)
                rank = np.zeros(len(flat), np.int64)
                if len(often):
                    place = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                    rank = np.where(often[place] == flat, seen[place], 0)
                order = np.lexsort((mix(flat), rank, text))
                first = np.cumsum(size) - size
                take = np.fromiter((prefix_size(n, similarity) for n in size.tolist()), np.int64, len(size))
                keep = np.arange(len(flat)) - first[text] < take[text]
                chosen, owner = flat[order[keep]], text[keep]
                prints = simhash128(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen.view(np.int64)), batch.column(0).slice(at, len(sets)).take(pa.array(owner)),
                     pa.array(prints[owner, 0]), pa.array(prints[owner, 1]), pa.array(size[owner].astype(np.int32))],
                    ["key", "node", "f1", "f2", "n"],
                )

    return rows.mapInArrow(run, "key long, node long, f1 long, f2 long, n int")


def _sizes_allow(n, m, similarity: float):
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _shared(prefixes: DataFrame, similarity: float) -> DataFrame:
    """The rows of shards of two texts or more, with the shard's first text as ``head`` and
    whether the row's text is near it.  One row of a shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, told = None, False  # the first row of the shard that may go on, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if carry is not None:
                cols = [np.concatenate(([a], b)) for a, b in zip(carry, cols, strict=True)]
            key, node, f1, f2, n = cols
            lead = np.concatenate(([True], key[1:] != key[:-1]))
            starts = np.flatnonzero(lead)
            run_ = np.cumsum(lead) - 1
            size = np.diff(np.append(starts, len(key)))
            give = size[run_] > 1
            if carry is not None and told:
                give[0] = False
            told = size[-1] > 1 or (carry is not None and told and len(starts) == 1)
            head = starts[run_]
            away = np.bitwise_count((f1 ^ f1[head]).view(np.uint64)) + np.bitwise_count((f2 ^ f2[head]).view(np.uint64)).astype(np.int64)
            near = (away <= RADIUS) & (node != node[head]) & _sizes_allow(n, n[head], similarity)
            carry = [c[starts[-1]] for c in cols]
            out = [key, node, f1, f2, n, node[head], near]
            yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in out], ["key", "node", "f1", "f2", "n", "head", "near"])

    return dealt_by_key(prefixes, "node").mapInArrow(run, "key long, node long, f1 long, f2 long, n int, head long, near boolean")


def similar_pairs(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose sets' exact similarity is ``similarity`` or more; ``rows(node, text)`` has their texts."""
    pairs = stash(pairs.distinct(), "pairs")
    fans = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    fans = stash(fans, "fans")
    nothing = F.lit(None).cast("long")
    text_of = rows.select(F.col("node").alias("t"), "text")
    asked = pairs.join(small(fans.filter("fans > 1"), 16), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("fans", F.lit(1))).cast("int").alias("salt"))
    asked = text_of.join(small(asked, 24), F.col("t") == F.col("u")).select("v", "salt", "u", "text")
    held = text_of.join(small(fans, 16), F.col("t") == F.col("v"))
    held = held.select("v", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), nothing.alias("u"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            v, salt, u = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = []
            for first, sets in _sets(batch.column(3)):
                for i, s in enumerate(sets, first):
                    if u[i] is None:
                        at, mine = (v[i], salt[i]), s
                        continue
                    if at != (v[i], salt[i]):
                        raise ValueError(f"the text of {v[i]} is missing")
                    common = len(np.intersect1d(mine, s, assume_unique=True))
                    if common >= similarity * (len(mine) + len(s) - common) - 1e-9:
                        found.append((u[i], v[i]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = held.unionByName(asked).repartition(n, "v", "salt").sortWithinPartitions("v", "salt", F.asc_nulls_first("u"))
    return met.mapInArrow(run, "u long, v long")


def _near(a: str, b: str, similarity: float) -> Column:
    away = F.bit_count(F.col(f"{a}.f1").bitwiseXOR(F.col(f"{b}.f1"))) + F.bit_count(F.col(f"{a}.f2").bitwiseXOR(F.col(f"{b}.f2")))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (away <= RADIUS) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shards whose texts are in more than one class, with their ``root``."""
    now = shared.select("key", "node", "f1", "f2", "n").join(small(roots, 16), "node", "left")
    now = now.withColumn("root", F.coalesce("root", "node"))
    ends = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "low")
    return now.join(ends, "key")


def _class_heads(open_: DataFrame, similarity: float) -> DataFrame:
    """In each shard, the first text of each class against that of the least class."""
    heads = open_.groupBy("key", "root").agg(F.min(F.struct("node", "f1", "f2", "n")).alias("head"), F.first("low").alias("low"))
    heads = heads.select("key", "root", "low", "head.*")
    least = heads.filter("root = low").select("key", "node", "f1", "f2", "n")
    met = heads.filter("root <> low").alias("a").join(least.alias("b"), "key").filter(_near("a", "b", similarity))
    return met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))


def _tree_pairs(open_: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs of a shard's texts that are not in one class, from BK-trees, where the
    maps of their sets leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_shards(batches):
            key, node, part, f1, f2, n, root = (batch.column(i).to_numpy() for i in range(7))
            maps = batch.column(7).to_pylist()
            fps = np.stack((f1, f2), axis=1).view(np.uint64)
            for a, b in shard_links(key, part, fps, RADIUS):
                keep = (root[a] != root[b]) & _sizes_allow(n[a], n[b], similarity)
                a, b = a[keep], b[keep]
                if len(a):
                    keep = may_be_similar(maps, n, a, b, similarity)
                    a, b = node[a[keep]], node[b[keep]]
                    both = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    rows = split_shards(open_.select("key", "node", "f1", "f2", "n", "root"), PIECE).join(small(bits, 512), "node")
    rows = dealt_by_key(rows.select("key", "node", "part", "f1", "f2", "n", "root", "bits"), "node")
    return rows.mapInArrow(run, "u long, v long")


def near_roots(rows: DataFrame, bits: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> DataFrame:
    """``rows(node, text)`` and their maps ``bits(node, bits)`` -> ``(node, root)`` of the texts that
    are near another, by verified links alone."""
    spark = rows.sparkSession
    shared = stash(_shared(_prefixes(rows, common, similarity), similarity), "shared")
    links = stash(similar_pairs(shared.filter("near").select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")), rows, similarity), "links")
    roots = components(links)
    for meet in (_class_heads, lambda rows_, similarity: _tree_pairs(rows_, bits, similarity)):
        open_ = stash(_open(shared, roots), "open")
        if not open_.limit(1).count():
            break
        found = stash(similar_pairs(meet(open_, similarity), rows, similarity), "links")
        drop_path(spark, open_.stash_path)
        if found.limit(1).count():
            links = links.unionByName(found)
            roots = components(links)
    drop_path(spark, shared.stash_path)
    return roots


def _row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that tells its documents apart, and the key's name: the id, and for
    further texts of a repeated id a number above all usual ids, made of id and text."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    id_ = F.col("doc_id").cast("long")
    again = docs.filter("doc_id is not null").groupBy(id_.alias("__id")).count().filter("count > 1").select("__id")
    again = stash(again, "again")
    if not again.limit(1).count():
        return docs.withColumn(name, id_), name
    again = small(again, 16)
    made = F.xxhash64(id_, empty_text("text")).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    repeated = docs.withColumn(name, made).join(again, id_ == F.col("__id"), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = repeated.groupBy(name).agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*", name)
    repeated = stash(repeated, "repeated")
    firsts = repeated.groupBy(id_.alias("__id")).agg(F.min(name).alias("__first"))
    repeated = repeated.join(small(firsts, 16), id_ == F.col("__id")).withColumn(name, F.when(F.col(name) == F.col("__first"), id_).otherwise(F.col(name))).drop("__id", "__first")
    return docs.withColumn(name, id_).join(again, id_ == F.col("__id"), "left_anti").unionByName(repeated), name


def drop_near(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one document (the least id) of each near-duplicate class; all columns are kept."""
    spark = docs.sparkSession
    keyed, name = _row_keys(docs)
    rows = keyed.select(F.col(name).alias("node"), empty_text("text").cast("binary").alias("text")).filter("node is not null")
    made = stash(_contents(rows), "contents")
    ids = made.filter("key is not null").select("node", "key")
    first = ids.groupBy("key").agg(F.min("node").alias("node"))
    copies = stash(ids.select("node").join(first.select("node"), "node", "left_anti"), "copies")
    common = _common(made)
    single = rows.join(small(copies, 16), "node", "left_anti")
    roots = near_roots(single, made.filter("key is not null").select("node", "bits"), common, similarity)
    gone = stash(copies.unionByName(roots.filter("node <> root").select("node")).select(F.col("node").alias("__gone")), "gone")
    drop_path(spark, made.stash_path)
    return keyed.join(small(gone, 16), F.col(name) == F.col("__gone"), "left_anti").drop(name)
