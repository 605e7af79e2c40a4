"""A corpus pipeline of four stages, each on all that the one before it kept.

1. toxicity: documents that the clause grammar rejects go;
2. SimHash near-dedup: one document of each near-duplicate class stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. SentencePiece encoding and decoding: digests of the remaining texts' ids and
   of what they decode to.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``.  Empty tables pass through; nulls are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, pieces, toxicity
from tessera.llm.common import read, stash
from tessera.llm.queries import MODEL


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(docs, MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: No stage but the last could be told in SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
