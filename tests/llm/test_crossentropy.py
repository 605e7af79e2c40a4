from __future__ import annotations

import math
import random
import re

import pytest

from tessera.llm import crossentropy as ce
from tessera.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, is_target string, words string"


def words_of(text):
    return [w for w in re.split("[\\x20\\x09-\\x0d]+", "".join(c.lower() if c < "\\x80" else c for c in text or "")) if w]


def brute(docs, good, smoothing):
    """Losses from plain dictionaries over the words themselves."""
    counts = [{}, {}]
    for d, text in docs:
        words = words_of(text)
        for side in (0, 1):
            if side or d in good:
                for item in [*words, *zip([None, *words], words, strict=False), *([None] if words else [])]:
                    counts[side][item] = counts[side].get(item, 0) + 1
    vocabulary = {k for k in counts[1] if isinstance(k, str)}
    totals = [sum(v for k, v in c.items() if isinstance(k, str)) for c in counts]
    out = []
    for d, text in docs:
        words = words_of(text)
        loss = []
        for c, scale in zip(counts, (1, totals[0] / totals[1]), strict=True):
            got = 0.0
            for before, w in zip([None, *words], words, strict=False):
                p = (scale * c.get(w, 0) + smoothing.word_mass) / (totals[0] + smoothing.word_mass * len(vocabulary))
                got -= math.log((scale * c.get((before, w), 0) + smoothing.context_mass * p) / (scale * c.get(before, 0) + smoothing.context_mass))
            loss.append(got / max(len(words), 1))
        out.append((d, len(words), *loss))
    return out


@pytest.mark.parametrize("block_bytes", [12 << 20, 20_000])
def test_whole_table_against_dictionaries(spark, block_bytes):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    smoothing = ce.Smoothing(block_bytes=block_bytes)
    got = {r["doc_id"]: r for r in ce.score_documents(docs, labels, smoothing).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], good, smoothing)
    assert len(got) == len(want)
    for d, n, a, b in want:
        r = got[d]
        assert r["n_words"] == n and abs(r["target_loss"] - a) < 1e-9 and abs(r["background_loss"] - b) < 1e-9
        assert abs(r["score"] - (a - b)) < 1e-9


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40))
    rows = [(i, text(), "", "") for i in range(60)]
    rows += [(100 + i, t, "", "") for i, (_, t, *_) in enumerate(rows[:20])]
    labels = spark.createDataFrame([(i, 1) for i in range(40, 60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in ce.score_documents(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 40))


def test_target_like_texts_score_lower(spark):
    rows = [(i, "the good text has good words in it " * 3, "", "") for i in range(20)] + [(100 + i, "buy cheap buy now buy pills " * 3, "", "") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in ce.score_documents(docs, labels).collect()}
    assert max(got[i] for i in range(20)) < min(got[100 + i] for i in range(20))


def test_edge_rows(spark):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " \n ", "", ""), (4, "a b", "", ""), (4, "a b", "", ""), (None, "a", "", ""), (5, "w " * 100_000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([(None, 1), (9, 0)], "doc_id long, quality int")
    got = ce.score_documents(docs, none).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)
    assert [r["score"] for r in got if r["doc_id"] in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert ce.score_documents(docs.limit(0), none).collect() == []
