from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import onebit
from tessera.llm.common import read

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_recall_on_the_whole_table(spark):
    rows = read(spark, SF, "embeddings")
    data = rows.collect()
    ids = np.array([r["vec_id"] for r in data])
    vectors = np.array([r["embedding"] for r in data], np.float64)
    got = {}
    for r in onebit.nearest(rows, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        found, want = sorted(got[int(ids[i])]), brute(ids, vectors, i, 20)
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        by = {int(j): s for j, s in zip(ids, (vectors * vectors[i]).sum(axis=1), strict=True)}
        assert all(abs(by[v] - s) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & {v for v, _ in want})
    assert hit / (20 * len(queries)) >= 0.99


def test_few_vectors_are_reranked(spark):
    rows = read(spark, SF, "embeddings").collect()
    vectors = np.array([r["embedding"] for r in rows], np.float64)
    codes = onebit.Codes.build(vectors)
    shares = [len(onebit.survivors(codes, np.arange(len(rows)) == i, vectors[i], 20)) / len(rows) for i in range(0, len(rows), 20)]
    print("reranked", np.mean(shares))
    assert np.mean(shares) < 0.1


def test_blocks_do_not_matter(spark):
    rows = read(spark, SF, "embeddings").filter("vec_id < 400")
    key = lambda df: sorted(map(tuple, df.collect()))
    big = key(onebit.nearest(rows, F.col("vec_id") % 20 == 0, 5))
    small = key(onebit.nearest(rows, F.col("vec_id") % 20 == 0, 5, base_block=64, query_block=4))
    assert [r[:3] for r in big] == [r[:3] for r in small]


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(3)
    for dims in (3, 64, 100):
        base = rng.standard_normal((2000, dims)) * rng.uniform(0.1, 5, (2000, 1))
        codes, inside = onebit.Codes.build(base), []
        for query in rng.standard_normal((20, dims)):
            estimate, bound = codes.estimate(query)
            inside.append((np.abs(estimate - base @ query) <= bound).mean())
        assert np.mean(inside) > 0.98


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [1.0, 0.0], "", ""), (2, [1.0, 0.0], "", ""), (3, None, "", ""), (4, [0.0, 0.0], "", ""), (5, [nan, 1.0], "", ""), (6, [inf, 1.0], "", ""), (7, [], "", ""), (8, [1.0, None], "", ""), (9, [1.0, 2.0, 3.0], "", ""), (20, [0.5, 0.5], "", ""), (None, [1.0, 1.0], "", "")]
    got = onebit.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert onebit.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).collect() == []


def test_rows_stay_where_they_are(spark):
    """Neither blocks of rows nor their codes are sent to each block of queries; a task holds one block."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v, "", "") for i, v in enumerate(rng.standard_normal((1200, 8)).tolist())], SCHEMA)
    plan = onebit.nearest(rows, F.col("vec_id") % 20 == 0, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "binary" not in plan and plan.count("MapInArrow") == 1


def test_wide_and_long_vectors(spark):
    """Lengths far apart, negative products, several words to a rotation, queries in chunks and repeated rows over cuts of blocks."""
    rng = np.random.default_rng(6)
    vectors = np.float32(rng.standard_normal((500, 130)) * 10.0 ** rng.integers(-20, 20, (500, 1)))
    vectors[1::2] = np.abs(vectors[1::2])
    data = [(i, v, "", "") for i, v in enumerate(vectors.tolist()) for _ in range(1 + i % 3)]
    vectors = vectors.astype(np.float64)
    for blocks in ({}, {"base_block": 7, "query_block": 9}):
        found = {}
        for r in onebit.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, 5, **blocks).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert sorted(found) == list(range(0, 500, 20))
        wanted = {q: [v for v, _ in brute(np.arange(500), vectors, q, 5)] for q in found}
        assert all(len(found[q]) == 5 for q in found)
        assert sum(len({v for _, v in found[q]} & set(wanted[q])) for q in found) >= 0.98 * 5 * len(found)
