from __future__ import annotations

import math
import random
import zlib

from tessera.llm import toxicity as tox
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"


def test_clause_arcs():
    g = tox.fit_grammar([])
    plain = g.clause("idiot".split())
    assert g.clause("you idiot".split()) > plain
    assert g.clause("not an idiot".split()) < tox.MATCHED <= plain
    assert g.clause("he said some words about an idiot".split()) < tox.MATCHED
    assert g.clause("you idiot he said".split()) < tox.MATCHED
    assert g.clause("idiot moron".split()) > 2 * plain
    assert g.clause("kill the process".split()) < tox.MATCHED <= g.clause("kill you".split())
    assert g.clause("never kill you".split()) < tox.MATCHED
    assert g.clause("a kind word".split()) == 0
    assert g.clause([]) == 0


def by_rule(symbols):
    """The weight of a clause of symbols, each harm of weight 1, from the rules' wording over positions."""
    total, matched, waiting = 0.0, False, None
    for i, x in enumerate(symbols):
        negated = tox.NEGATION in symbols[max(i - tox.REACH, 0) : i]
        aimed = tox.TARGET in symbols[max(i - tox.REACH, 0) : i]
        if x == tox.TARGET and waiting is not None and i - waiting <= tox.WAIT:
            total, waiting = total + tox.FULFILLED, None
        if x not in (tox.INSULT, tox.THREAT):
            continue
        if negated:
            total += tox.NEGATED
            continue
        weight = tox.AIMED if aimed else 1.0
        if x == tox.THREAT and not aimed:
            weight, waiting = tox.LOOSE, i
        total += weight * (tox.REPEATED if matched else 1.0)
        matched = True
    return total * (tox.REPORTED if tox.REPORT in symbols else 1.0)


def test_composed_grammar_against_the_rules():
    words = {s: (s, 1.0) for s in range(6)}
    g = tox.Grammar(words=words)
    rng = random.Random(6)
    for _ in range(3000):
        symbols = [rng.choice(range(6)) for _ in range(rng.randint(0, 14))]
        assert math.isclose(g.clause(symbols), by_rule(symbols), abs_tol=1e-9), symbols


def test_arcs_change_labels():
    rows = [(f"you are an idiot {i}. fine weather", 1) for i in range(20)] + [(f"so it is {i}. fine weather", 0) for i in range(60)]
    texts = ["he is not an idiot", "she said you are an idiot", "idiot, he wrote", "never an idiot here"]
    full = tox.fit_grammar(rows)
    off = tox.fit_grammar(rows, clauses=tox.clause_grammar(reported=1, negated=1, aimed=1, loose=1, fulfilled=0, repeated=1))
    assert all(full.score(t) < 0.5 <= off.score(t) for t in texts)
    assert full.score("you are an idiot") >= 0.5


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = tox.score_documents(docs, tox.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def test_learns_from_the_other_fold_only(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    flipped = labels.selectExpr("doc_id", "quality", f"case when {held} then 1 - toxic else toxic end as toxic")
    assert tox.fit(docs, labels) == tox.fit(docs, flipped)


def test_edge_rows(spark):
    rows = [(1, None, 7.0), (2, "", 1.0), (3, "...", 1.0), (4, "you idiot, you moron. " * 3, 0.0), (4, "you idiot, you moron. " * 3, 0.0), (None, "fine words", 0.0), (5, "word " * 100_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (None, 1)], "doc_id long, toxic int")
    g = tox.fit(docs, labels)
    got = tox.score_documents(docs, g).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] == by[5]["score"]
    assert by[4]["score"] > by[5]["score"] and by[None]["held_out"] is False
    assert tox.score_documents(docs.limit(0), g).collect() == []
    kept = tox.drop_toxic(docs, tox.fit_grammar([("you idiot", 1)] * 9 + [("so it is", 0)] * 9))
    assert kept.columns == docs.columns and 4 not in {r["doc_id"] for r in kept.collect()} and kept.count() == 5
