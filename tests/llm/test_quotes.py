from __future__ import annotations

import random
import re

from tessera.llm import quotes
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, body string, source string"


def norm(text):
    return re.sub(r"\s+", " ", "".join(c.lower() if c.isascii() else c for c in text)).strip()


def parse(text):
    runs = []
    for line in re.split(r"\r?\n", text):
        mark = re.match(r"(?:[ \t]*>)*", line)[0]
        level, rest = mark.count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)
        if runs and runs[-1][0] == level:
            runs[-1][1] += "\n" + rest
        else:
            runs.append([level, rest])
    return runs


def brute(rows):
    """Plain parsing, linking and ordering of (conv, turn, role, text) rows."""
    parsed, quoted = [], {}
    for conv, turn, role, text, *_ in rows:
        text = text or ""
        runs = parse(text) if re.search(r"(?m)^[ \t]*>", text) else [[0, text]]
        body = "\n".join(t for n, t in runs if not n)
        body = body.strip() if len(runs) > 1 or runs[0][0] else text
        parsed.append((conv, turn, role, body))
        if conv is not None and turn is not None:
            quoted.setdefault((conv, turn), set()).update((n, norm(t)) for n, t in runs if n and norm(t))
    bodies = {}
    for conv, turn, _, body in parsed:
        if conv is not None and turn is not None:
            bodies.setdefault(conv, []).append((turn, f" {norm(body)} "))
    links, counts = {}, {}
    for (conv, turn), qs in quoted.items():
        found = [(n, max((t for t, body in bodies[conv] if t < turn and f" {q} " in body), default=None)) for n, q in qs]
        counts[conv, turn] = (len(found), sum(s is not None for _, s in found))
        good = [(-n, s) for n, s in found if s is not None]
        links[conv, turn] = max(good)[1] if good else None
    out = []
    for conv, turn, role, body in parsed:
        root = turn
        while links.get((conv, root)) is not None:
            root = links[conv, root]
        out.append((conv, turn, role, body, links.get((conv, turn)), root, *counts.get((conv, turn), (0, 0))))
    return out


def check(spark, rows):
    got = quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    flat = [(r["conv_id"], r["turn"], r["role"], r["body"], r["reply_to"], r["thread"], r["n_quotes"], r["n_linked"]) for r in got]
    assert sorted(flat, key=key) == sorted(brute(rows), key=key)
    for conv in {r["conv_id"] for r in got}:
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        order = [(r["thread"] is not None, r["thread"] or 0, r["turn"] or 0) for r in mine]
        assert order == sorted(order)


def test_nested_quotes(spark):
    first = "Hello there.\n\nA second  paragraph\nof two lines."
    rows = [
        (1, 0, "a", first, "", ""), (1, 1, "b", "Unrelated", "", ""), (1, 2, "c", "> hello THERE.\nI agree.", "", ""),
        (1, 3, "d", "> I agree.\n>> Hello there.\nMe too\r\n> I agree.", "", ""), (1, 4, "e", "> a second paragraph\n> of two lines.\n\nYes.", "", ""),
        (1, 5, "f", "> nobody wrote this\nok", "", ""), (1, 6, "g", " > > unrelated\n", "", ""), (2, 0, "a", "> Hello there.\nother conversation", "", ""),
        (1, 7, "h", ">>> deep\n> me too", "", ""), (1, 8, "h", "x > y", "", ""),
    ]
    check(spark, rows)
    got = {r["turn"]: r for r in quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 1").collect()}
    assert (got[2]["reply_to"], got[3]["reply_to"], got[4]["reply_to"], got[7]["reply_to"]) == (0, 2, 0, 3)
    assert got[7]["thread"] == 0 and got[3]["body"] == "Me too" and got[5]["reply_to"] is None


def test_parts_of_messages(spark):
    first = "One line of the message here.\nTwo, the second of its lines. And a sentence more of it.\nThree, the last of the lines there are."
    rows = [
        (1, 0, "a", first, "", ""), (1, 1, "b", "> Two, the second of its lines. And a sentence more of it.\n> Three, the last of the lines there are.\nfine", "", ""),
        (1, 2, "c", "> And a sentence\n> more of it.\nyes", "", ""), (1, 3, "d", "> sentence more of it.\n> One line\nno", "", ""), (1, 4, "e", ">> the second of its lines. And a sentence more of it. Three, the last\n> fine\nwell", "", ""),
    ]
    check(spark, rows)
    got = {r["turn"]: r["reply_to"] for r in quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: None, 4: 1}


def test_made_quotes_over_the_table(spark):
    """The given conversations hold no quotes, so excerpts of earlier messages are put before their texts; one
    conversation is much longer than a bucket and one passage is quoted by many."""
    rng = random.Random(12)
    given = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read(spark, SF, "conversations").collect() if r["conv_id"] is not None and r["turn"] is not None]
    given += [(10**6, i, "user", f"message {i % 700} of a long thread with the same eight words before {i}") for i in range(2500)]
    before, rows = {}, []
    for conv, turn, role, text in sorted(given, key=lambda r: r[:2]):
        earlier, lead = before.setdefault(conv, []), ""
        for _ in range(rng.choice((0, 1, 1, 2)) if earlier else 0):
            words = (rng.choice(earlier) or "x").split() or ["x"]
            at = rng.randrange(len(words))
            part = words[at : at + rng.choice((1, 5, 8, 9, 30))] if rng.random() < 0.7 else ["a", "long", "thread", "with", "the", "same", "eight", "words", "before"]
            if rng.random() < 0.1:
                part.append("unheard")
            cut = rng.randrange(len(part) + 1)
            mark = ">" * rng.choice((1, 1, 2)) + " "
            lead += mark + " ".join(part[:cut]).upper() + "\n" + mark + " ".join(part[cut:]) + "\n"
        earlier.append(text)
        rows.append((conv, turn, role, lead + (text or ""), "", ""))
    check(spark, rows)


def test_edge_rows(spark):
    rows = [(1, 0, "a", None, "", ""), (1, 0, "a", None, "", ""), (1, 1, None, "", "", ""), (None, 0, "a", "> x", "", ""), (1, None, "b", "> x", "", ""), (1, 2, "u", ">", "", ""), (3, 0, "u", "word " * 50_000, "", ""), (3, 1, "u", "> " + "word " * 50_000 + "\nyes", "", "")]
    check(spark, rows)
    chain = [(9, i, "u", ("> " + f"line {i - 1}\n" if i else "") + f"line {i}", "", "") for i in range(40)]
    check(spark, chain)
    assert quotes.reply_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"], "", "") for r in read(spark, SF, "conversations").collect()]
    check(spark, rows)
