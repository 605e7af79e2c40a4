"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Only DataFrame operations are used.  Words are the runs of letters and digits of
the lower-cased text; shingles are five consecutive words (of an item with
fewer, all of them).

A window of a document has as many words as an item.  A window that is similar
to an item at ``similarity`` or more shares a set number of shingles with it, so
that many places of the window hold one of the item's: every window of a
document with so many places is fingerprinted, in whatever order they stand, and
no other can reach the similarity.  Windows of equal content are fingerprinted
once.  Fingerprints meet those of items of the same size through
a multi-index: 64 bits are cut into ``radius + 1`` blocks, and two fingerprints
within the radius agree on a block, so none is lost.  Pairs within the radius are
verified by their exact weighted-shingle similarity: the sum over shingles of
the lesser of their two counts over the sum of the greater.

The benchmark's shingles and blocks are broadcast if their counted size is small,
and joined by shuffle otherwise.

Defined cases: null and empty texts and items have no window; documents shorter
than an item are one window; repeated items and rows count once; rows with a
null id are not reported; an empty table on either side gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, stash

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of ``k`` consecutive words, in order; none for fewer words."""

    def hashed(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(F.size(w) >= k, found).otherwise(F.array().cast("array<bigint>"))

    # bound as a lambda's argument, so that the words are made once a text and not once a shingle
    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def _fingerprint(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` by ``keys`` with the SimHash of the array ``column`` as ``fp`` and its size as ``n``."""
    low = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(0x0000000100000001)).alias(f"c{k}") for k in range(32)]
    summed = rows.select(*keys, F.explode(column).alias("h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *low)
    fp = F.lit(0).cast("long")
    for k in range(32):
        for half, bit in ((F.col(f"c{k}").bitwiseAND(0xFFFFFFFF), k), (F.shiftrightunsigned(f"c{k}", 32), 32 + k)):
            fp = fp.bitwiseOR(F.shiftleft((2 * half > F.col("n")).cast("long"), bit))
    return summed.select(*keys, "n", fp.alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*(F.shiftleft(c, 8).bitwiseOR(F.lit(i)) for i, c in enumerate(cut)))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``(item_id, k, words, shingles)`` of each distinct item with words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    items = stash(items.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE))), "item_words")
    parts = [items.filter(F.col("k") == k).select("item_id", "k", F.size("w").alias("words"), shingles_of(F.col("w"), k).alias("shingles")) for k in range(1, SHINGLE + 1)]
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, item_id, start, distance, similarity)``: the most similar window of each
    document and item at ``similarity`` or more (ties: the first window)."""
    items = stash(item_shingles(benchmark), "items")
    known = stash(items.select(F.col("item_id"), F.col("k").alias("ik"), "words", F.explode(F.array_distinct("shingles")).alias("h")), "known")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five
    near = small(known, 32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w")).filter("doc_id is not null")
    found = None
    for k in sizes:
        texts = rows.select("doc_id", shingles_of(F.col("w"), k).alias("s")).withColumn("size", F.size("s"))
        met = texts.select("doc_id", "size", F.posexplode("s").alias("p", "h")).join(near.filter(F.col("ik") == k), "h")
        length = F.col("words") - (k - 1)  # shingles of a window
        width = F.least(length, F.col("size"))
        # common / (width + length - common) >= s needs common >= s (width + length) / (1 + s)
        need = F.greatest(F.ceil(similarity / (1 + similarity) * (width + length) - 1e-9), F.lit(1)).cast("int")
        places = met.groupBy("doc_id", "size", "item_id", "words").agg(F.sort_array(F.collect_set("p")).alias("ps"))
        places = places.withColumn("need", need).withColumn("width", width).filter(F.size("ps") >= F.col("need"))
        # the windows that hold places i .. i + need - 1
        runs = places.select("doc_id", "size", "words", "width", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("ps") - F.col("need")),
            lambda i: F.struct(F.get("ps", i).alias("first"), F.get("ps", i + F.col("need") - 1).alias("last")),
        )).alias("r"))
        low = F.greatest(F.col("r.last") - F.col("width") + 1, F.lit(0))
        high = F.least(F.col("r.first"), F.col("size") - F.col("width"))
        starts = runs.filter(low <= high).select("doc_id", "size", "words", "width", F.explode(F.sequence(low, high)).alias("start")).distinct()
        starts = stash(starts, "starts")
        part = texts.join(small(starts, 32), ["doc_id", "size"])
        part = part.select("doc_id", "words", F.lit(k).alias("k"), "start", F.slice("s", F.col("start") + 1, F.col("width")).alias("window"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, distance int, similarity double")
    found = found.withColumn("wid", F.struct("k", "words", F.xxhash64("window").alias("a"), F.hash("window").alias("b")))
    found = stash(found.distinct(), "windows")
    contents = found.groupBy("wid").agg(F.min("window").alias("window"))
    prints = stash(_fingerprint(contents, ["wid"], "window"), "prints")
    item_prints = _fingerprint(items.filter("size(shingles) > 0"), ["item_id", "k", "words"], "shingles")
    item_prints = stash(item_prints, "item_prints")
    index = item_prints.select("item_id", F.col("k").alias("ik"), F.col("words").alias("iw"), F.col("fp").alias("ifp"), F.col("n").alias("item_n"), F.explode(_blocks(F.col("fp"), radius)).alias("block"))
    asked = prints.select("wid", "fp", "n", F.col("wid.k").alias("ik"), F.col("wid.words").alias("iw"), F.explode(_blocks(F.col("fp"), radius)).alias("block"))
    pairs = asked.join(small(index, 64), ["ik", "iw", "block"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))))
    pairs = pairs.filter(F.col("distance") <= radius).select("wid", "item_id", "n", "item_n", "distance").distinct()
    pairs = stash(pairs, "pairs")
    window_counts = contents.join(pairs.select("wid").distinct(), "wid", "left_semi").select("wid", F.explode("window").alias("h")).groupBy("wid", "h").count()
    item_counts = items.select("item_id", F.explode("shingles").alias("h")).groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("item_count"))
    shared = (
        pairs.join(window_counts, "wid").join(small(stash(item_counts, "item_counts"), 32), ["item_id", "h"])
        .groupBy("wid", "item_id").agg(F.first("n").alias("n"), F.first("item_n").alias("item_n"), F.first("distance").alias("distance"), F.sum(F.least("count", "item_count")).alias("common"))
    )
    alike = shared.select("wid", "item_id", "distance", (F.col("common") / (F.col("n") + F.col("item_n") - F.col("common"))).alias("similarity"))
    alike = alike.filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("b")
    hits = found.select("doc_id", "start", "wid").join(small(stash(alike, "alike"), 64), "wid").groupBy("doc_id", "item_id").agg(best)
    return hits.select("doc_id", "item_id", "b.start", "b.distance", "b.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns are kept."""
    gone = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("__gone")).distinct()
    gone = small(stash(gone, "gone"), 16)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
