from __future__ import annotations

import random
import zlib

import pytest

from tessera.llm import shards
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, size int, shard string"


def brute_capacity(sizes: list[int], n: int) -> int:
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                used, load = used + 1, 0
            load += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


def fetcher(ends):
    def fetch(spans, width):
        cells = {}
        for e in ends:
            for a, b in spans:
                if a < e <= b:
                    cells.setdefault((a, (e - a - 1) // width), []).append(e)
        return [(min(c), max(c), len(c)) for c in cells.values()]

    return fetch


@pytest.mark.parametrize("cells", [3, 16, 4096])
def test_capacity_is_minimal_at_any_resolution(cells):
    rng = random.Random(cells)
    for _ in range(60):
        sizes = [rng.choice((16, 17, 40, rng.randint(16, 900), rng.randint(16, 9000))) for _ in range(rng.randint(1, 160))]
        ends, total = [], 0
        for s in sizes:
            total += s
            ends.append(total)
        n = rng.randint(1, 12)
        cuts = shards.minimax_cuts(shards.Ends(total, fetcher(ends), cells), n)
        assert set(cuts) <= set(ends) and cuts[-1] == total and len(cuts) <= n
        assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == brute_capacity(sizes, n)


def check(rows, docs, n, capacity=True):
    assert len(rows) == len(docs)
    size = {}
    groups = {}
    for d, text, *_ in docs:
        groups.setdefault(text or "", []).append(d)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    for k in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    where = {r["doc_id"]: r["shard"] for r in rows}
    for ids in groups.values():
        assert len({where[i] for i in ids}) == 1
    order = sorted(groups, key=lambda t: min(groups[t]))
    sizes = [(len(t.encode()) + 16) * len(groups[t]) for t in order]
    assert max(size.values()) == brute_capacity(sizes, n)
    assert len(size) == min(n, len(groups))
    assert [where[min(groups[t])] for t in order] == sorted(where[min(groups[t])] for t in order)


def test_whole_table(spark):
    docs = read(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = shards.shard_documents(docs, 40).collect()
    check(rows, list(texts.items()), 40)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
    coarse = shards.shard_documents(docs, 40, cells=50).collect()
    check(coarse, list(texts.items()), 40)


def test_edge_rows(spark):
    rows = [(3, None, 1, ""), (1, "", 1, ""), (7, "é" * 50_000, 1, ""), *((100 + i, "same", 1, "") for i in range(500)), (8, "x", 1, ""), (9, "y", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = shards.shard_documents(docs, 40).collect()
    check(got, rows, 40)
    assert shards.shard_documents(docs.limit(0), 40).collect() == []
    twice = shards.shard_documents(spark.createDataFrame([(1, "a", 0, ""), (1, "a", 0, ""), (None, "b", 0, "")], SCHEMA), 2).collect()
    assert len(twice) == 3 and sorted((r["shard"], r["slot"]) for r in twice) == [(0, 0), (1, 0), (1, 1)]
