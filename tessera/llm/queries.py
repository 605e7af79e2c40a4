"""One query for each operator, over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crossentropy, decontaminate, onebit, pieces, quotes, shards, simhash, toxicity, urls, warc
from tessera.llm.common import read

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(read(spark, sf_dir, "documents"), simhash.SimHash(words=4, lanes=1, radius=4))
    return classes.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(read(spark, sf_dir, "documents"), MODEL)


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(read(spark, sf_dir, "conversations"))


def op5_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossentropy.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"), 40)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (
        op1_simhash_bktree, op2_sentencepiece_spans, op3_toxicity_grammar, op4_quote_threads, op5_onebit_neighbours,
        op6_warc_chunks, op7_simhash_decontamination, op8_url_vocabulary, op9_cross_entropy_difference, op10_minimax_shards,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def _terms(terms: tuple[str, ...]) -> str:
    return "|".join(terms)


def oracle_sql() -> dict[str, str]:
    strict = f"regexp_matches(t, '(^|[^a-z0-9])({_terms(urls.STRICT)})($|[^a-z0-9])')"
    soft = " + ".join(f"regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::INT" for term in urls.SOFT)
    hosts = {r.name: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in urls.RULES}
    longest = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"WHEN {hosts[r.name]} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN {hosts[r.name]} THEN '{r.verdict}'" for r in longest)
    count = " + ".join(f"len(regexp_extract_all(t2, '[^a-z0-9]{term}([^a-z0-9])'))" for term in urls.STRICT)
    digit = "(('0x' || substr(h, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4)::INT)) & 31"
    base32 = f"list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({digit}) + 1, 1)), 'string_agg', '')"
    return {
        "op6_warc_chunks": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
            SELECT page_id, payload_bytes, {base32} AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to
            FROM d
        """,
        "op8_url_vocabulary": f"""
            WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
                         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
            t AS (SELECT *, translate(host || path, '{urls.UPPER}', '{urls.LOWER}') AS t FROM s),
            n AS (SELECT *, ({soft})::INT AS soft_hits, {strict} AS any_strict,
                         ' ' || regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS t2 FROM t)
            SELECT page_id, host, path, CASE {rule} END AS rule,
                   CASE {verdict} WHEN any_strict OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
                   CASE WHEN any_strict THEN greatest(1, ({count})) ELSE 0 END::INT AS strict_hits, soft_hits
            FROM n
        """,
    }
