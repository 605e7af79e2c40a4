"""URL filtering by host rules and a weighted URL vocabulary.

Rules come first: a rule names a host and a path beginning, fits that host and
all its subdomains, and the longest fitting one decides.  Where none fits, an
Aho-Corasick automaton runs over the lower-cased host and path and counts
strict and soft terms that stand between boundaries (the ends, or characters
other than ASCII letters and digits); one strict hit or ``soft_limit`` distinct
soft hits reject the url.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; repeated rows are judged each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The vocabulary's terms.
STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "malware", "phishing", "warez", "cheap-pills", "spam-farm")
SOFT = ("cheap", "pills", "spam", "farm", "free", "win", "winner", "bonus", "bet", "betting", "adult", "sex", "loan", "loans", "crack", "torrent", "pharmacy", "poker", "deal", "deals", "click", "hot")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    has = F.coalesce(F.instr(url, F.lit("://")) > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


class Vocabulary:
    """Strict and soft terms in one automaton."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str], soft_limit: int = 2):
        self.limit, self.automaton = soft_limit, ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.automaton.add_word(term, (term, kind))
        self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, int]:
        """Strict hits, and distinct soft terms, between boundaries."""
        strict, soft = 0, set()
        for end, (term, kind) in self.automaton.iter(text):
            start = end + 1 - len(term)
            if start and _inner(text[start - 1]) or end + 1 < len(text) and _inner(text[end + 1]):
                continue
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)

    def rejects(self, text: str) -> bool:
        strict, soft = self.hits(text)
        return strict > 0 or soft >= self.limit


def _inner(char: str) -> bool:
    return char.isascii() and char.isalnum()


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict, strict_hits, soft_hits)``."""
    terms = (tuple(strict), tuple(soft))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*terms, soft_limit)
        for batch in batches:
            found = [own.hits(x.translate(_LOWER)) for x in batch.column("__text").to_pylist()]
            strict_hits, soft_hits = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(strict_hits, pa.int32()), pa.array(soft_hits, pa.int32())],
                [*batch.schema.names, "strict_hits", "soft_hits"],
            )

    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__text", F.concat("host", "path"))
    judged = rows.mapInArrow(run, "page_id long, host string, path string, __text string, strict_hits int, soft_hits int")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")


_LOWER = str.maketrans(UPPER, LOWER)
