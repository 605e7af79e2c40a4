from __future__ import annotations

import datetime
import random

import pytest

from tessera.operators.asof import AmbiguousMatch, AsofError, AsofSpec, MissingByKey, TimeKeyTypeMismatch, UnorderedTimeKey, asof_join

SPEC = {"spine_by": ["k"], "spine_time": "t", "facts_by": ["fk"], "facts_time": "ft"}


def run(spark, spine, facts, **more):
    s = spark.createDataFrame(spine, "k string, t long, row int")
    f = spark.createDataFrame(facts, "fk string, ft long, v int")
    return {r["row"]: r["v"] for r in asof_join(s, f, AsofSpec(**SPEC | more)).collect()}


def brute(spine, facts, direction="backward", boundary="inclusive", tolerance=None):
    out = {}
    for k, t, row in spine:
        ok = [(ft, v) for fk, ft, v in facts if k is not None and t is not None and fk == k and ft is not None]
        past = [(ft, v) for ft, v in ok if ft < t or ft == t and boundary == "inclusive"]
        ahead = [(ft, v) for ft, v in ok if ft > t or ft == t and boundary == "inclusive"]
        a, b = max(past, default=None), min(ahead, default=None)
        if direction == "forward":
            hit = b
        elif direction == "nearest":
            hit = a if a and (not b or t - a[0] <= b[0] - t) else b
        else:
            hit = a
        out[row] = hit[1] if hit and (tolerance is None or abs(t - hit[0]) <= tolerance) else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("boundary", ["inclusive", "exclusive"])
@pytest.mark.parametrize("buckets", [0, 5])
def test_matches_brute_force(spark, direction, boundary, buckets):
    rng = random.Random(8)
    keys = ["a"] * 6 + ["b", "c", None]
    spine = [(rng.choice(keys), rng.choice([None, *range(60)]), i) for i in range(200)]
    facts = list({(k, t): (k, t, i) for i, (k, t) in enumerate((rng.choice(keys), rng.choice([None, *range(60)])) for _ in range(120))}.values())
    for tolerance in (None, 3):
        got = run(spark, spine, facts, direction=direction, boundary=boundary, tolerance=tolerance, time_buckets=buckets)
        assert got == brute(spine, facts, direction, boundary, tolerance)


def test_ties(spark):
    spine, facts = [("a", 5, 0)], [("a", 3, 1), ("a", 3, 2), ("z", 1, 1), ("z", 1, 2)]
    with pytest.raises(AmbiguousMatch):
        run(spark, spine, facts)
    assert run(spark, spine, facts[2:]) == {0: None}
    assert run(spark, spine, [*facts, ("a", 3, None)], tie_break="v") == {0: 2}


def test_global_group_schema_and_dates(spark):
    s = spark.createDataFrame([(datetime.date(2024, 1, 9), 1)], "t date, row int")
    f = spark.createDataFrame([(datetime.date(2024, 1, 5), 7)], "ft date, v int")
    spec = AsofSpec([], "t", [], "ft", tolerance=4)
    out = asof_join(s, f, spec)
    assert out.columns == ["t", "row", "v"] and out.collect()[0]["v"] == 7
    assert asof_join(s, f, AsofSpec([], "t", [], "ft", tolerance=3)).collect()[0]["v"] is None


def test_refusals(spark):
    s, f = spark.createDataFrame([("a", 1, 1.0)], "k string, t long, x double"), spark.createDataFrame([("a", 1, 2)], "fk string, ft int, v int")
    for error, more in ((MissingByKey, {"spine_by": ["none"]}), (UnorderedTimeKey, {"spine_time": "x"}), (TimeKeyTypeMismatch, {}), (AsofError, {"direction": "up"})):
        with pytest.raises(error):
            asof_join(s, f, AsofSpec(**SPEC | more))
