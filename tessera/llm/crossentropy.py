"""Cross-entropy difference between a target and a background language model.

Both are bigram models with Dirichlet smoothing towards their unigrams, over one
shared vocabulary: every distinct word of the corpus.  Words and pairs are told
apart by 64-bit hashes and counted exactly, over all words of all documents; no
count is merged, pruned or sampled, and the tables grow with the corpus.  The
target model is counted over the documents marked as targets, the background
over all documents.  The models are matched: background counts are scaled to the
target's number of words, so the same pseudo-counts weigh alike in both.

    p(word) = (count + word_mass) / (N + word_mass * V)
    p(word | context) = (count of the pair + context_mass * p(word)) / (count of the context + context_mass)

A document's score is the mean over its words of the target model's loss less
the background's, in nats: the lower, the more like the target.

No table of counts is broadcast or gathered.  Documents are dealt to blocks of
about ``block_bytes``.  A block counts its own words and pairs; the counts meet by
key, and a key that several blocks hold is told its totals back, to those blocks
alone; other keys' totals are the block's own.  A block, or as large a share of the
keys, is one task's memory, and a common word costs a row for each block and no more.

Defined cases: null, empty and wordless texts have no word and score 0; without
any target document both models are the smoothing's and all scores are 0; repeated
rows are counted and scored each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import empty_text, small, stash
from tessera.llm.shingles import mix, words_of_texts

ONE = np.uint64(1)
#: The context of a text's first word; keys of words are odd, those of pairs even.
START = np.uint64(0x5DEECE66D1CE4E5B)


@dataclass(frozen=True)
class Smoothing:
    context_mass: float = 4.0
    word_mass: float = 0.05
    #: Bytes of text of a block.
    block_bytes: int = 12 << 20


def keyed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the words of all texts and of the pairs they close, the number of words of each
    text, and which words open one."""
    words, sizes = words_of_texts(texts)
    words |= ONE
    opens = np.zeros(len(words), bool)
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.concatenate((words[:1], words[:-1]))
    before[opens] = START
    pairs = mix((before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words) & ~ONE
    return words, pairs, sizes, opens


def counted(words: np.ndarray, pairs: np.ndarray, n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs; the start counts once a text with words."""
    keys, counts = np.unique(np.concatenate((words, pairs)), return_counts=True)
    at = int(np.searchsorted(keys, START))
    return np.insert(keys, at, START), np.insert(counts, at, n_starts)


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x`` by place value, which compress well where high ones are zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def shares(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the ``n`` equal ranges of keys begins in the sorted ``keys``, and their end."""
    edges = np.array([(s << 64) // n for s in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition: one block's, or one share of the keys."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """``docs(doc_id, text, is_target)`` with the number of the block of each row."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("is_target", F.lit(False)).alias("is_target"), empty_text("text").cast("binary").alias("text"))


def block_counts(rows: DataFrame, n: int) -> DataFrame:
    """``(share, block, first, steps, own, target)``: the keys of a block that lie in a share, as
    steps from the first one, with how often its texts hold them, and its target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _whole(batches)
        if part is None:
            return
        block = part["block"][0].as_py()
        words, pairs, sizes, opens = keyed(part["text"].to_pylist())
        chosen = np.asarray(part["is_target"].to_numpy(), bool)
        del part
        keys, own = counted(words, pairs, int((sizes > 0).sum()))
        some = np.repeat(chosen, sizes)
        target = np.zeros(len(keys), np.int64)
        hit, found = counted(words[some], pairs[some], int((sizes[chosen] > 0).sum()))
        target[np.searchsorted(keys, hit)] = found
        del words, pairs
        edges = shares(keys, n)
        for share in np.flatnonzero(np.diff(edges)).tolist():
            cut = slice(edges[share], edges[share + 1])
            k = keys[cut]
            cells = [share, block, int(k[0].view(np.int64)), planes(np.diff(k)), planes(own[cut].astype(np.uint32)), planes(target[cut].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), *(pa.binary(),) * 3), strict=True)], ["share", "block", "first", "steps", "own", "target"])

    return rows.select("block", "is_target", "text").repartitionById(n, "block").mapInArrow(run, "share int, block int, first long, steps binary, own binary, target binary")


def totals(counts: DataFrame, n: int) -> DataFrame:
    """``(block, share, told, n, t)``: which of a block's keys in a share other blocks hold too, as
    bits, and the corpus totals of those; and with a null block, of each share, how many
    words it has (``share``) and their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _whole(batches)
        if part is None:
            return
        names, share = ["block", "share", "told", "n", "t"], part["share"][0].as_py()
        keys = [np.cumsum(np.concatenate((np.array([f], np.int64).view(np.uint64), from_planes(s, np.uint64)))) for f, s in zip(part["first"].to_pylist(), part["steps"].to_pylist(), strict=True)]
        own, target = (np.concatenate([from_planes(x, np.uint32) for x in part[c].to_pylist()]) for c in ("own", "target"))
        blocks = part["block"].to_pylist()
        del part
        place, distinct = pd.factorize(np.concatenate(keys))
        held = np.bincount(place)
        # exact: a double holds whole numbers up to 2**53
        n, t = (np.bincount(place, weights=c).astype(np.int64) for c in (own, target))
        words = ((distinct & ONE) == ONE) & (distinct != START)
        sums = [pa.nulls(1, pa.int32()), pa.array([int(words.sum())], pa.int64()), pa.nulls(1, pa.binary()), *(pa.array([int(c[words].sum()).to_bytes(8, "little")]) for c in (n, t))]
        yield pa.RecordBatch.from_arrays(sums, names)
        at = 0
        for block, k in zip(blocks, keys, strict=True):
            p = place[at : at + len(k)]
            at += len(k)
            told = held[p] > 1
            cells = [pa.array([block], pa.int32()), pa.array([share], pa.int64()), pa.array([np.packbits(told).tobytes()]), *(pa.array([planes(c[p[told]])]) for c in (n, t))]
            yield pa.RecordBatch.from_arrays(cells, names)

    return counts.repartitionById(n, "share").mapInArrow(run, "block int, share long, told binary, n binary, t binary")


def score(docs: DataFrame, smoothing: Smoothing = Smoothing()) -> DataFrame:  # noqa: B008
    """``docs(doc_id, text, is_target)`` -> ``(doc_id, n_words, target_loss, background_loss, score)`` for each row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // smoothing.block_bytes))
    rows = in_blocks(docs, n_blocks)
    made = stash(totals(block_counts(rows, n_blocks), n_blocks), "totals")
    vocabulary = all_words = all_targets = 0
    for r in made.filter("block is null").select("share", "n", "t").toLocalIterator():  # three numbers of each share
        vocabulary, all_words, all_targets = vocabulary + r["share"], all_words + int.from_bytes(r["n"], "little"), all_targets + int.from_bytes(r["t"], "little")
    scale = all_targets / all_words if all_words else 0.0
    context_mass, word_mass = smoothing.context_mass, smoothing.word_mass
    whole = all_targets + word_mass * vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _whole(batches)
        if part is None:
            return
        is_text = part["is_text"].combine_chunks()
        texts = part.filter(is_text)
        told = part.select(["share", "told", "n", "t"]).filter(pc.invert(is_text)).sort_by("share")
        del part
        if not len(texts):
            return
        words, pairs, sizes, opens = keyed(texts["text"].to_pylist())
        n_words = len(words)
        place, keys = pd.factorize(np.concatenate((words, np.array([START]), pairs)))
        del words, pairs
        place = place.astype(np.int32)
        own, pair = place[:n_words], place[n_words + 1 :]
        context = np.concatenate((own[:1], own[:-1]))
        context[opens] = start = place[n_words]
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(keys)
        edges = shares(keys[order], n_blocks)
        losses = []
        for name, chosen, factor in (("t", np.asarray(texts["is_target"].to_numpy(), bool), 1.0), ("n", np.ones(len(texts), bool), scale)):
            some = chosen[text]
            counts = np.bincount(place[:n_words][some], minlength=len(keys)) + np.bincount(pair[some], minlength=len(keys))
            counts[start] = (sizes[chosen] > 0).sum()
            for share, bits, total in zip(told["share"].to_pylist(), told["told"].to_pylist(), told[name].to_pylist(), strict=True):
                mine = order[edges[share] : edges[share + 1]]
                counts[mine[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)]] = from_planes(total, np.int64)
            counts = counts * factor
            word = (counts + word_mass) / whole
            p = (counts[pair] + context_mass * word[own]) / (counts[context] + context_mass)
            losses.append(np.bincount(text, weights=-np.log(p), minlength=len(texts)) / np.maximum(sizes, 1))
        a, b = losses
        ids = texts["doc_id"].combine_chunks()
        for i in range(0, len(ids), 1 << 14):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, 1 << 14), *(pa.array(x[i : i + (1 << 14)]) for x in (sizes.astype(np.int64), a, b, a - b))],
                ["doc_id", "n_words", "target_loss", "background_loss", "score"],
            )

    def empty(kind: str):
        return F.lit(None).cast(kind)

    told = made.filter("block is not null").select("block", F.lit(False).alias("is_text"), empty("long").alias("doc_id"), empty("boolean").alias("is_target"), empty("binary").alias("text"), "share", "told", "n", "t")
    asked = rows.select("block", F.lit(True).alias("is_text"), "doc_id", "is_target", "text", empty("long").alias("share"), *(empty("binary").alias(c) for c in ("told", "n", "t")))
    met = told.unionByName(asked).repartitionById(n_blocks, "block")
    return met.mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def mark_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, is_target)``: whether the id is labelled as of good quality."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    joined = docs.select("doc_id", "text").join(small(good, 16), F.col("doc_id") == F.col("__good"), "left")
    return joined.select("doc_id", "text", F.col("__good").isNotNull().alias("is_target"))


def score_documents(docs: DataFrame, labels: DataFrame, smoothing: Smoothing = Smoothing()) -> DataFrame:  # noqa: B008
    return score(mark_targets(docs, labels), smoothing)
