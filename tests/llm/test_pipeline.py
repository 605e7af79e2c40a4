from __future__ import annotations

import hashlib
import re

import corpus_pipeline

from tessera.llm import decontaminate, pieces, toxicity
from tessera.llm.common import read, stash

SF = "/root/testdata/sf0.001"


def least_of_classes(texts):
    """The least id of each component of pairs of similarity 0.8 or more, by brute force over the words."""
    words = {d: [w for w in re.split("[\\x20\\x09-\\x0d]+", "".join(c.lower() if c < "\\x80" else c for c in t or "")) if w] for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for d, w in words.items()}
    near = {d: {o for o in sets if o == d or 5 * len(sets[o] & sets[d]) >= 4 * len(sets[o] | sets[d])} for d in sets}
    left, done = set(), set()
    for d in sorted(sets):
        if d in done:
            continue
        left.add(d)
        todo = {d}
        while todo:
            done |= todo
            todo = set().union(*(near[o] for o in todo)) - done
    return left


def test_stages_by_their_operators(spark):
    docs = read(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    grammar = toxicity.fit(docs, read(spark, SF, "labels"))
    kept = {d for d, r in rows.items() if grammar.score(r["text"]) < 0.5}
    now = stash(corpus_pipeline.without_toxic(spark, docs, SF))
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == kept

    left = least_of_classes({d: rows[d]["text"] for d in kept})
    now = stash(corpus_pipeline.without_near_duplicates(spark, now, SF))
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == left

    leaked = {r["doc_id"] for r in decontaminate.contaminated(now, read(spark, SF, "benchmark")).collect()}
    now = stash(corpus_pipeline.without_benchmark(spark, now, SF))
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == left - leaked

    model = pieces.codec(corpus_pipeline.MODEL).model
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(done) == left - leaked
    for d, r in done.items():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, model.encode(rows[d]["text"]))).encode()).hexdigest()


def test_near_duplicates_by_shingle_similarity(spark):
    docs = read(spark, SF, "documents")
    left = least_of_classes({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()} == left


def test_empty_table_passes_through(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
