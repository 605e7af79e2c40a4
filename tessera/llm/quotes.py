"""Quotation linking: conversations in reply order, without their quotes.

Only DataFrame operations are used.  A line's quote level is the number of ``>``
marks it opens with; consecutive lines of one level form a passage.  Lines of
level 0 are the message's own body.  Passages and bodies are normalised (A-Z
lower-cased, white space collapsed).  A quoted passage is linked to the latest earlier
message of its conversation whose body holds the passage's words as a run, so whole
messages, some of their lines, sentences and quotes wrapped anew are all found.
The message's ``reply_to`` is the latest message that one of its least nested
linked passages comes from.  A message without a linked quote opens a thread of its own.

Candidates come from hashes of ``WINDOW`` consecutive words (of a shorter passage, of
all of them): a body that holds a passage holds every window of it, so the passage
meets the bodies of its rarest window alone, and is then looked for in their texts.
A passage that many messages quote is looked for once; its sources and its quotes
then meet by turns, in buckets of ``TURNS`` turns, so neither a long conversation nor a much
quoted passage stands in one task.

Messages come in reply order: threads in the order of their opening messages, and
inside a thread by turn, so a message stands after the one it answers.
Positions are numbered from 0 with a range partitioning and running counts of
partitions, so a conversation of any length is spread over tasks; thread roots
are found by pointer jumping over the linked messages alone.

Defined cases: a null text is an empty one; messages with a null conversation or
turn keep a row, are never linked, and stand first; repeated rows are numbered
each; quotes that match nothing are removed from the body and stay unlinked; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stash
from tessera.llm.urls import LOWER, UPPER

QUOTE_LINE = r"(?m)^[ \t]*>"
PASSAGES = "array<struct<level:int,text:string>>"
#: Words of a window, and turns of a bucket.
WINDOW, TURNS = 8, 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"\s+", " "))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none of fewer words."""
    found = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(k)), " "), F.lit(k)))
    return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<bigint>"))


def passages(text: Column) -> Column:
    """Passages ``(level, text)`` of a message, in order."""
    lines = F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, r"^(?:[ \t]*>)*", 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "").alias("text"),
        ),
    )

    def cut(rows: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(rows, i)["level"] != F.get(rows, i - 1)["level"])
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), first)

        def whole(at: Column) -> Column:
            def passage(s: Column, j: Column) -> Column:
                mine = F.slice(rows, s + 1, F.coalesce(F.get(at, j + 1), F.size(rows)) - s)
                return F.struct(F.get(rows, s)["level"].alias("level"), F.array_join(F.transform(mine, lambda x: x["text"]), "\n").alias("text"))

            return F.transform(at, passage)

        return _bound(starts, whole)

    return _bound(lines, cut).cast(PASSAGES)


def parsed(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, body, quotes)``: the own text, and the quoted passages."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has = F.regexp_like(text, F.lit(QUOTE_LINE))
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), has.alias("has"),
        F.when(has, passages(text)).otherwise(F.array().cast(PASSAGES)).alias("all"),
    )
    own = F.array_join(F.transform(F.filter("all", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    body = F.when(F.col("has"), F.trim(F.regexp_replace(own, r"^\s+|\s+$", ""))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", body.alias("body"), F.filter("all", lambda p: p["level"] > 0).alias("quotes"))


def passage_sources(named: DataFrame, quoted: DataFrame) -> DataFrame:
    """``(conv_id, t, turn)``: the messages whose bodies hold the words of each distinct passage
    ``quoted(conv_id, t)`` as a run."""
    words = F.split("t", " ")
    short = sorted(r[0] for r in quoted.select(F.size(words).alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # less than WINDOW numbers
    keys = F.when(F.size(words) >= WINDOW, _bound(words, lambda w: windows(w, WINDOW))).otherwise(F.array(F.xxhash64("t", F.size(words))))
    parts = stash(quoted.select("conv_id", "t", F.explode(F.array_distinct(keys)).alias("key")), "parts")
    asked = parts.select("conv_id", "key").distinct()
    own = named.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", normalised(F.col("body")).alias("own")).filter("own <> ''")
    own = stash(own.distinct(), "bodies")
    held = _bound(F.split("own", " "), lambda w: F.concat(*(windows(w, k) for k in (*short, WINDOW))))
    places = own.select("conv_id", "turn", F.explode(F.array_distinct(held)).alias("key"))
    places = stash(places.join(asked, ["conv_id", "key"], "left_semi").distinct(), "places")
    often = places.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"))
    # a window that no body holds counts zero: its passage has no source
    rarest = parts.join(often, ["conv_id", "key"], "left").groupBy("conv_id", "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("conv_id", "t", F.col("r.key").alias("key"))
    found = rarest.join(places, ["conv_id", "key"]).select("conv_id", "turn", "t").join(own, ["conv_id", "turn"])
    space = F.lit(" ")
    return found.filter(F.contains(F.concat(space, "own", space), F.concat(space, "t", space))).select("conv_id", "t", "turn").distinct()


def linked_passages(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, source)`` of each distinct quoted passage; ``source`` is null if unlinked."""
    named = rows.filter("conv_id is not null and turn is not null")
    wanted = stash(
        named.filter("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q"))
        .select("conv_id", "turn", F.col("q.level").alias("level"), normalised(F.col("q.text")).alias("t")).filter("t <> ''").distinct(),
        "quoted",
    )
    sources = passage_sources(named, stash(wanted.select("conv_id", "t").distinct(), "distinct"))
    none = F.lit(None)
    events = sources.select("conv_id", "t", "turn", F.col("turn").alias("source"), F.lit(1).alias("kind"), F.lit(0).alias("level")).unionByName(
        wanted.select("conv_id", "t", "turn", none.cast("long").alias("source"), F.lit(0).alias("kind"), "level")
    )
    events = stash(events.withColumn("t", F.xxhash64("t", F.length("t"))).withColumn("bucket", F.floor(F.col("turn") / TURNS)), "events")
    # the last source of the buckets before, then the last one inside the bucket; at equal turns a
    # quote stands before its own message, so it links to an earlier one
    ends = events.groupBy("conv_id", "t", "bucket").agg(F.max("source").alias("last"))
    above = F.max("last").over(W.partitionBy("conv_id", "t").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("conv_id", "t", "bucket", above.alias("before"))
    inside = W.partitionBy("conv_id", "t", "bucket").orderBy("turn", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = events.withColumn("source", F.last("source", ignorenulls=True).over(inside)).filter("kind = 0")
    return told.join(ends, ["conv_id", "t", "bucket"], "left").select("conv_id", "turn", "level", F.coalesce("source", "before").alias("source"))


def reply_links(passages_: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, quotes, linked)`` of each quoting message."""
    best = F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), F.col("source"))))
    return passages_.groupBy("conv_id", "turn").agg(
        best.alias("reply_to"), F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max("level").alias("deepest")
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """``links(conv_id, turn, reply_to)`` -> ``(conv_id, turn, root)`` by pointer jumping."""
    now = stash(links.filter("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("root")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        after = stash(now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if not after.filter("moved").limit(1).count():
            return after.select("conv_id", "turn", "root")
        now = after.select("conv_id", "turn", "root")


def reply_order(messages: DataFrame) -> DataFrame:
    """``(conv_id, position, turn, role, body, reply_to, thread, n_quotes, n_linked)`` for each message."""
    spark = messages.sparkSession
    rows = parsed(messages)
    found = stash(linked_passages(rows), "passages")
    links = stash(reply_links(found), "links")
    roots = thread_roots(links)
    about = links.join(roots, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_to", "n_quotes", "n_linked", "root")
    rows = rows.drop("quotes").join(about, ["conv_id", "turn"], "left")
    rows = rows.withColumn("thread", F.coalesce("root", "turn")).drop("root")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["conv_id", "thread", "turn", "role", "body"]
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = stash(laid.withColumn("part", F.shiftright("at", 33).cast("int")), "laid")
    spans = laid.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    joined = laid.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("position"), "turn", "role", "body", "reply_to", "thread",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
