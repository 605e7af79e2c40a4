from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.operators import conformal, evaluation, graph, sampling, stats


def test_welch_and_mann_whitney(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8]
    rows = spark.createDataFrame([(0, x) for x in a] + [(1, x) for x in b], "side int, value double")
    got = stats.welch_t(rows)
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t, df = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    grid = np.linspace(0, abs(t), 200_001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    p = 1 - 2 * np.trapezoid(density, grid)
    assert (got["t"], got["df"], got["p"]) == pytest.approx((t, df, p), abs=1e-8)
    u = stats.mann_whitney(rows).first()["u"]
    wins = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert u == min(wins, len(a) * len(b) - wins)


def test_projection(spark):
    axis = stats.projection_axis(6)
    assert np.linalg.norm(axis) == pytest.approx(1) and axis == stats.projection_axis(6) != stats.projection_axis(6, seed=8)
    v = np.random.default_rng(3).standard_normal((20, 6)).astype("float32")
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, None), (21, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (22, []), (23, [2.0])]
    got = {r["id"]: r["value"] for r in stats.projected(spark.createDataFrame(rows, "id int, vector array<float>"), axis).collect()}
    assert [got[i] for i in range(20)] == pytest.approx((v.astype(float) @ axis).tolist())
    assert got[20] is None and got[21] is None and got[22] == 0.0 and got[23] == pytest.approx(2 * axis[0])


def test_pit_calibration_error(spark):
    rng = random.Random(5)
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "record_id long, pit double")
    for n, power in ((4, 1), (103, 3), (250, 1)):
        pits = [round(rng.random() ** power, 2) for _ in range(n)]
        bins, want = min(10, n), 0.0
        cuts = [k * n // bins for k in range(bins + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            mean = float(np.mean(sorted(pits)[a:b]))
            want += (b - a) / n * max(abs(mean - (a + b) / 2 / n) - math.sqrt(mean * (1 - mean) / (b - a)), 0)
        assert evaluation.pit_calibration_error(frame([*pits, None])).first()["pit_error"] == pytest.approx(want, abs=1e-12)
    for bad in ([0.5, 1.5], [0.5, float("nan")], [None]):
        with pytest.raises(Exception, match="PIT values"):
            evaluation.pit_calibration_error(frame(bad)).collect()
    with pytest.raises(ValueError):
        evaluation.pit_calibration_error(frame([0.5]), 0)


def test_wasserstein_and_cosines(spark):
    rng = random.Random(1)
    a, b = sorted(rng.random() for _ in range(50)), sorted(rng.random() + 0.2 for _ in range(80))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "value double")
    grid = np.linspace(0, 1, 80)
    want = np.abs(np.interp(grid, np.linspace(0, 1, 50), a) - b).mean() / ((a[-1] - a[0]) * 1.02)
    assert stats.wasserstein(frame(a), frame(b)).first()["wasserstein"] == pytest.approx(want)
    v = np.random.default_rng(2).standard_normal((9, 5))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [unit[i] @ unit[j] for i in range(9) for j in range(i)]
    df = spark.createDataFrame([(x.tolist(),) for x in v], "vector array<double>")
    assert stats.mean_pairwise_cosine(df) == pytest.approx(np.mean(pairs)) and stats.mean_pairwise_cosine(df.limit(1)) == 1.0
    assert stats.cosine_shift([], [1]) == 0.0 and stats.cosine_shift([1, 0], [0, 2]) == 1.0


def test_bootstrap_and_gaussian_process():
    low, high = stats.bootstrap_interval(list(range(100)), 500)
    assert low < 49.5 < high and stats.bootstrap_interval(list(range(99, -1, -1)), 500) == (low, high)
    x = np.linspace(0, 3, 7)[:, None]
    gp = stats.GaussianProcess.fit(x, np.sin(x[:, 0]))
    mean, var = gp.posterior(x)
    assert np.abs(mean - np.sin(x[:, 0])).max() < 0.05 and (var >= 0).all()
    assert (gp.expected_improvement(np.array([[1.0], [9.0]]), 0.9) >= 0).all()


def test_calibration_scores(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 0.5), (2, 1.0, 2.0, -3.0)], "record_id int, mean double, sd double, outcome double")
    for r, (m, s, y) in zip(evaluation.gaussian_scores(rows).orderBy("record_id").collect(), ((0, 1, 0.5), (1, 2, -3)), strict=True):
        z, cdf = (y - m) / s, 0.5 * (1 + math.erf((y - m) / s / math.sqrt(2)))
        assert r["crps"] == pytest.approx(s * (z * (2 * cdf - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)), abs=1e-6)
        assert r["pit"] == pytest.approx(cdf, abs=2e-7)
    draws = [1.0, 4.0, 2.0, 7.0]
    got = evaluation.sample_scores(spark.createDataFrame([(1, draws, 3.0)], "record_id int, draws array<double>, outcome double")).first()
    want = np.mean([abs(x - 3) for x in draws]) - np.mean([abs(x - y) for x in draws for y in draws]) / 2
    assert got["crps"] == pytest.approx(want) and got["pit"] == 0.5


def test_entities(spark):
    assert evaluation.bio_spans(["B-A", "I-A", "I-B", "B-B", "O"], [(1, 2), (3, 4), (5, 6), (7, 8), (9, 9)], [1, 0, 1, 0.5, 1]) == [("A", 1, 4, 0.5), ("B", 7, 8, 0.5)]
    gold = spark.createDataFrame([(1, "A", 0, 2), (1, "B", 3, 4)], "row_id int, label string, start int, end int")
    found = spark.createDataFrame([(1, "A", 0, 2), (1, "A", 5, 6)], gold.schema)
    got = {r["label"]: (r["precision"], r["recall"]) for r in evaluation.entity_scores(gold, found).collect()}
    assert got == {"A": (0.5, 1.0), "B": (0.0, 0.0), "(all)": (0.5, 0.5)}


def test_conformal_sets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 400)
    label = [int(rng.choice(3, p=q)) for q in p]
    rows = spark.createDataFrame([(i, int(c), float(p[i, c])) for i in range(400) for c in range(3)], "id int, label int, p double")
    truth = spark.createDataFrame(list(enumerate(label)), "id int, label int")
    for method in ("lac", "aps", "raps"):
        sets = conformal.conformalize(rows.filter("id < 200"), truth, rows.filter("id >= 200"), 0.1, method, 0.01, 1)
        covered = [label[r["id"]] in r["prediction_set"] for r in sets.collect()]
        assert len(covered) == 200 and np.mean(covered) > 0.82
    empty = spark.createDataFrame([(1.0,)], "score double")
    assert conformal.conformal_quantile(empty, 0.1).first()["quantile"] == math.inf
    cqr = conformal.conformalize_cqr(spark.createDataFrame([(0.0, 1.0, float(i) / 10) for i in range(30)], "lower double, upper double, observed double"), spark.createDataFrame([(1, 0.0, 1.0)], "id int, lower double, upper double"), 0.2)
    assert cqr.first()["upper"] == pytest.approx(2.4)
    groups = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 5.0)], "g string, score double")
    assert {r["g"]: r["quantile"] for r in conformal.mondrian_quantiles(groups, 0.1, "g").collect()} == {"a": 18.0, "b": math.inf, "": 18.0}


def test_vector_aggregates(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("a", [3.0, 5.0]), ("b", None), (None, [1.0, 1.0])], "g string, v array<float>")
    got = {r["g"]: r["vector_mean"] for r in vec.vector_aggregate(rows, ["g"], "v", "mean").collect()}
    assert got == {"a": [2.0, 3.5], "b": None, None: [1.0, 1.0]}
    with pytest.raises(ValueError):
        vec.vector_aggregate(rows, ["v"], "g", "sum")
    with pytest.raises(Exception, match="unequal width"):
        vec.vector_aggregate(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], rows.schema), ["g"], "v", "sum").collect()
    bits = rows.filter("g = 'a' and v is not null").select(vec.sign_bits(F.col("v"), F.array(F.lit(2.0), F.lit(2.0))).alias("b")).collect()
    assert {r["b"] for r in bits} == {"00", "11"}


def test_graph_details(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "id string, vector array<float>")
    own = graph.build_neighbor_graph(nodes, 2, self_exclude=False).filter("rank = 1").collect()
    assert all(r["src"] == r["dst"] and r["similarity"] == 1.0 for r in own) and len(own) == 3
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "b", 2.0), ("a", "a", 1.0), ("b", "c", -1.0), ("c", "x", None), (None, "a", 1.0)], "src string, dst string, weight double")
    got = {r["id"]: r["vector"] for r in graph.propagate(nodes, edges, hops=1, alpha=0.0, weighting="similarity").collect()}
    assert got["a"] == pytest.approx([1.0, 0.2 / 3], abs=1e-6) and got["b"] == pytest.approx([1.0, 0.1], abs=1e-6) and got["c"] == pytest.approx([0.0, 1.0])
    wide = graph.propagate(nodes, edges, hops=2, output="jumping").first()["vector"]
    assert len(wide) == 6
    with pytest.raises(ValueError):
        graph.propagate(nodes, edges, hops=9)
    kinds = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", None, 2.0), ("c", "d", "y", None)], "src string, dst string, kind string, w double")
    cols = graph.EdgeColumns(type="kind", weight="w")
    assert graph.edge_rows(kinds, cols, edge_types=["x", "y"]).count() == 2 and graph.edge_rows(kinds, cols, min_weight=1.5).count() == 1
    starts = spark.createDataFrame([("a",)], "start string")
    assert {r["node"] for r in graph.gather(starts, kinds, 2).collect()} == {"b", "c"}
    pairs = sampling.walk_pairs(kinds.select("src", "dst"), walks=3, length=3, q=0.5, seed=1)
    first = sorted(map(tuple, pairs.collect()))
    assert first == sorted(map(tuple, pairs.repartition(3).collect())) and {a for a, _ in first} == {"a", "b", "c", "d"}
    lists = spark.createDataFrame([("n", list("abcdef"))], "node string, list array<string>")
    assert len(set(sampling.fanout_sample(lists, 3, 5).first()["sample"])) == 3
    mined = graph.hard_negatives(spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "e", 1)], "src string, dst string, rank int"), spark.createDataFrame([("a", "b")], "anchor string, positive string"), 5)
    assert [(r["anchor"], r["negative"]) for r in mined.collect()] == [("a", "c")]


def test_similar_to_matches_whole_values(spark):
    from tessera.streaming.predicate import matching

    rows = spark.createDataFrame([("abc",), ("zabcz",), ("a.c",), ("q similar to z",), ("ab",)], "x string")
    found = lambda p: sorted(r["x"] for r in matching(rows, p).collect())
    assert found("x SIMILAR TO 'a%'") == ["a.c", "ab", "abc"]
    assert found("x similar to 'abc'") == ["abc"]
    assert found("x SIMILAR TO 'a.c'") == ["a.c"]
    assert found("x SIMILAR TO 'a(b|x)c?'") == ["ab", "abc"]
    assert found("x NOT SIMILAR TO 'a%' AND x = 'q similar to z'") == ["q similar to z"]


def test_numbered_is_the_global_order(spark):
    from pyspark.sql import functions as F

    from tessera.operators.ranking import numbered

    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    got = sorted((r["n"], r["v"]) for r in numbered(rows, ["v"], "n").collect())
    assert [n for n, _ in got] == list(range(1000)) and [v for _, v in got] == sorted(v for _, v in got)


def test_retrieval_within_classes_makes_no_pairs(spark):
    """The same as from all pairs of a class, without a join of the items by their class."""
    from tessera.operators import evaluation

    labels = [0] * 9 + [1] * 2 + [2] + [None] * 2 + [3] * 3
    items = spark.createDataFrame([(str(i), l, 0 if l == 3 else i % 4) for i, l in enumerate(labels)], "id string, label int, grade int")
    ranked = spark.createDataFrame([(str(q), str((q + s * 5) % 17), s) for q in range(17) for s in (1, 2, 3, 4)], "query_id string, id string, rank int")
    a, b = items.alias("a"), items.alias("b")
    relevant = a.join(b, "label").filter("a.id <> b.id").selectExpr("a.id as query_id", "b.id as id", "b.grade as grade")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for k in (1, 3, 10):
        assert rounded(evaluation.retrieval_within_classes(ranked, items, k)) == rounded(evaluation.retrieval_per_query(ranked, relevant, k))
