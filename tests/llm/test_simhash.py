from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import neardup, simhash
from tessera.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, node string"


def brute_fingerprint(text: str, k: int = 4) -> int:
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_whole_table_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    got = {r["doc_id"]: (int.from_bytes(r["fp"], "big"), r["component_id"]) for r in simhash.near_classes(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], fps, 4)
    assert got == {r["doc_id"]: (f, c) for r, f, c in zip(rows, fps, want, strict=True)}
    assert len({c for _, c in got.values()}) < len(got)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None, "x", "y"), (3, "", "", ""), (9, " \t\n", "", ""), (7, "One two", "", ""), (7, "One two", "", ""), (8, "ONE  TWO\n", "", ""), (None, "one two", "", ""), (1, long, "", ""), (2, long + " end", "", ""), (4, "a b c d e", "", "")]
    got = simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[5]["component_id"] == by[3]["component_id"] == by[9]["component_id"] == 3
    assert by[5]["fp"] == b"\0" * 8
    assert by[7]["component_id"] == by[8]["component_id"] == 7
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_classes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("piece", [8192, 16])
def test_shards_lose_no_link(spark, piece):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = list(dict.fromkeys(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)))
    rows = [(i, f.to_bytes(8, "big")) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "node long, fp binary")
    links = simhash.near_links(distinct, simhash.SimHash(piece=piece))
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps, 4)


def test_forest_is_the_sequential_tree_and_finds_all(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 10, 300, dtype=np.uint64).reshape(-1, 1)
    fps = fps[np.sort(np.unique(fps, axis=0, return_index=True)[1])]
    forest = simhash.Forest(fps, np.zeros(len(fps), np.int64))
    children = {}
    for i in range(1, len(fps)):
        at = 0
        while True:
            d = int(fps[i, 0] ^ fps[at, 0]).bit_count()
            if (at, d) not in children:
                children[at, d] = i
                break
            at = children[at, d]
    assert dict(zip(forest.key.tolist(), forest.node.tolist(), strict=True)) == {a * 65 + d: i for (a, d), i in children.items()}
    pairs = {(int(a), int(b)) for q, n in forest.links(fps, np.zeros(len(fps), np.int64), np.arange(len(fps)), 3) for a, b in zip(q, n, strict=True)}
    assert pairs == {(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 3}


def test_near_dedup_catches_copies_and_leave_others(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(60):
        words = [word() for _ in range(300)]
        near = list(words)
        for p in rng.sample(range(300), 2):
            near[p] = word()
        rows += [(3 * i, " ".join(words), "", ""), (3 * i + 1, " ".join(near), "", ""), (3 * i + 2, " ".join(word() for _ in range(300)), "", "")]
    docs = spark.createDataFrame([*rows, rows[0], (None, "alone", "", "")], SCHEMA)
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert {i for i in ids if i is not None and i % 3 != 1} == {r[0] for r in rows if r[0] % 3 != 1}
    assert sum(1 for i in ids if i is not None and i % 3 == 1) <= 1


def test_drop_near_against_brute_force_jaccard(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(150)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(200)] if i % 3 else passage + [word() for _ in range(20 + i % 40)]
        near = list(words)
        for p in rng.sample(range(len(words)), rng.randint(1, 8)):  # similarities on both sides of 0.8
            near[p] = word()
        rows += [" ".join(words), " ".join(near)]
    rows += ["", None, " ", "one two", "One  two", rows[0]]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"] for r in neardup.drop_near(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)).collect()}
    assert got == {i for i in range(len(rows)) if find(i) == i}


def test_parity_maps_never_reject_a_near_pair():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 4, 5, 9, 60, 300, 340, 3000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0, 0.05, 0.1, 0.2, 0.4):
            other = base.copy()
            other[: int(share * n)] = rng.integers(0, 1 << 63, int(share * n))
            sets.append(np.unique(other))
    bits, n = [neardup.parity_bits(s) for s in sets], np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    kept = neardup.may_be_similar(bits, n, a, b, 0.8)
    exact = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    far = (exact < 0.6) & (np.minimum(n[a], n[b]) >= 0.8 * np.maximum(n[a], n[b]))
    assert kept[exact >= 0.8].all() and far.any() and kept[far].mean() < 0.1


def test_search_frontier_is_bounded():
    """Wide searches spread out their children a bounded number at a time, and lose no link by it."""
    import tracemalloc

    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, (8192, 2), dtype=np.uint64)
    fps[4096:] = fps[:4096] ^ (np.uint64(1) << rng.integers(0, 63, (4096, 2), dtype=np.uint64))
    forest, found = simhash.Forest(fps, np.zeros(8192, np.int64)), 0
    tracemalloc.start()
    for query, _ in forest.links(fps, np.zeros(8192, np.int64), np.arange(8192), 48):
        found += len(query)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(int((np.bitwise_count(fps[:i] ^ fps[i]).sum(axis=1) <= 48).sum()) for i in range(8192))
    assert peak < 60e6
