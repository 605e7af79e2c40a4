"""BM25 over a postings table (k1 = 1.2, b = 0.75), AND semantics by default.

Tokens are runs of letters and digits, lower-cased, of at most forty characters.
The index is two DataFrames: postings ``(term, doc, tf)`` and lengths
``(doc, dl)``; written partitioned by a hash of the term they serve any number of
queries without another pass over the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, LONGEST = 1.2, 0.75, 40


@dataclass
class LexicalIndex:
    postings: DataFrame
    lengths: DataFrame

    def search(self, query: str, k: int, match_all: bool = True) -> DataFrame:
        """``(doc, score, rank)``: the k best, ties by id; ranks count from 0."""
        terms = sorted({t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) <= LONGEST})
        if not terms:
            return self.postings.sparkSession.createDataFrame([], "doc string, score double, rank int")
        hits = self.postings.filter(F.col("term").isin(terms))
        stats = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        scored = hits.join(F.broadcast(df), "term").join(self.lengths, "doc").crossJoin(F.broadcast(stats))  # one row of totals
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        found = scored.groupBy("doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))
        if match_all:
            found = found.filter(F.col("matched") == len(terms))
        best = found.select("doc", "score").orderBy(F.desc("score"), F.asc("doc")).limit(k)
        ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc"))).alias("l"))  # k rows at most
        return ranked.select(F.posexplode("l").alias("rank", "e")).select("e.doc", (-F.col("e.s")).alias("score"), F.col("rank").cast("int").alias("rank"))


def build_index(docs: DataFrame, key: str, columns: list[str]) -> LexicalIndex:
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= LONGEST))
    rows = docs.select(F.col(key).cast("string").alias("doc"), tokens.alias("tokens"))
    postings = rows.select("doc", F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    return LexicalIndex(postings, rows.select("doc", F.size("tokens").alias("dl")))
