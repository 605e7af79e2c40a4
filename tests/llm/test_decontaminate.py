from __future__ import annotations

import random
import re
from collections import Counter

from tessera.llm import decontaminate as dec
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string, item_id string, w string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws):
    k = min(5, len(ws))
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()


def brute(doc, item):
    """The best weighted-shingle similarity of any item-sized window."""
    d, i = words(doc), words(item)
    want, k = shingles(i), min(5, len(i))
    best = 0.0
    for s in range(max(1, len(d) - len(i) + 1)):
        window = d[s : s + len(i)]
        have = Counter(tuple(window[j : j + k]) for j in range(len(window) - k + 1))
        top = sum((have | want).values())
        best = max(best, sum((have & want).values()) / top if top else 0.0)
    return best


def test_whole_table_against_all_windows(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dec.contaminated(docs, items).collect()}
    named = [(r["item_id"], r["text"], set(shingles(words(r["text"])))) for r in items.collect()]
    want = {}
    for r in docs.collect():
        have = set(shingles(words(r["text"])))
        for item, text, known in named:
            if len(known & have) >= 0.3 * len(known) and (s := brute(r["text"], text)) >= 0.8:
                want[r["doc_id"], item] = s
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_near_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(30, 90))), "") for i in range(40)]
    docs, clean = [], []
    for i, text, _ in items:
        ws = text.split()
        ws[len(ws) // 2] = word()
        around = lambda: " ".join(word() for _ in range(50))
        docs.append((i, f"{around()}\n{' '.join(ws).upper()}, {around()}", "", ""))
        clean.append((1000 + i, around() + " " + " ".join(ws[: len(ws) // 2]) + " " + around(), "", ""))
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(spark.createDataFrame(docs + clean, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(d[0], i[0]) for d in docs for i in items if brute(d[1], i[1]) >= 0.8}
    assert got == want and len(want) > 15


def test_edge_rows(spark):
    text = "one two three four five six seven eight nine ten"
    items = [(1, text, ""), (1, text, ""), (2, None, ""), (3, "", ""), (4, "alpha beta", ""), (None, "x y z", ""), (5, " ".join(f"v{i}" for i in range(3000)), ""), (6, "aa " * 30, "")]
    docs = [(10, text, "", ""), (10, text, "", ""), (11, None, "", ""), (12, "", "", ""), (13, "so Alpha, BETA it is", "", ""), (None, text, "", ""), (14, "one two three four five six seven eight nine", "", ""), (15, " ".join(f"v{i}" for i in range(3001)), "", ""), (16, "aa " * 31, "", ""), (17, "x y z", "", "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dec.contaminated(d, i).collect()}
    assert got == {(10, 1): 1.0, (13, 4): 1.0, (14, 1): 5 / 6, (15, 5): 1.0, (16, 6): 1.0}
    kept = dec.drop_contaminated(d, i)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["11", "12", "17", "None"]
    assert dec.contaminated(d.limit(0), i).collect() == [] and dec.contaminated(d, i.limit(0)).collect() == []
    assert dec.drop_contaminated(d, i.limit(0)).count() == len(docs)


def test_moved_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    items, docs = [], []
    for i, (n, moved) in enumerate([(50, 8), (55, 12), (100, 20), (100, 50), (60, 0), (60, 30)]):
        ws = [word() for _ in range(n)]
        items.append((i, " ".join(ws), ""))
        around = lambda: " ".join(word() for _ in range(40))
        docs.append((i, f"{around()} {' '.join(ws[n - moved:] + ws[:n - moved])} {around()}", "", ""))
        docs.append((10 + i, " ".join(ws[: round(0.85 * n)]), "", ""))  # shorter than the item
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dec.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(d[0], i[0]): s for d in docs for i in items if (s := brute(d[1], i[1])) >= 0.8}
    assert {(0, 0), (1, 1), (2, 2), (3, 3)} <= set(want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
