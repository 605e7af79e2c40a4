"""Toxicity scored by a weighted finite-state grammar over clauses.

A text is cut into clauses at sentence marks, semicolons and line ends.  A
lexical transducer maps each word to a symbol and a weight: insults and threats
(given terms, and terms and word beginnings learned from labelled rows), targets
(second and third persons, demonstratives), negation, reported speech, and
everything else.  Four transducers over those symbols are written as tables of
arcs and composed into one:

* reported speech: a clause with a reporting verb ends with a low final weight;
* negation: an insult or threat within ``REACH`` words of a negation weighs little;
* target: one near a target weighs more; a threat without one weighs little, and
  a target that follows it makes good the rest;
* insult: further matches of a clause weigh more than the first.

A clause's weight is the sum of its arcs' emissions times the final weight of the
state it ends in; a clause is matched if that is ``MATCHED`` or more, so a negated
or reported insult is none.  A document's features are the sum, the greatest and the
number of its matched clauses' weights, and their share of the clauses; a logistic
layer, fitted on the same labelled rows, turns them into a score from 0 to 1.

Learned from labelled rows are the insult and threat terms beyond the given
ones, the weights and the logistic layer, on at most ``max_rows`` of them, taken
in the order of a hash of their ids.  Their texts stay on the executors: terms are
counted and features made there.  Language, source and id are never inputs of a
score.

Defined cases: null, empty and wordless texts have no matched clause and get the
score of such documents; texts are scored whole; repeated rows get equal scores; of
several texts of a labelled id the least is learned from;
without a labelled row of each class the given terms and fixed weights are used;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import empty_text, small, stash

# The words each transducer knows before anything is learned.
INSULTS = ("idiot", "moron", "scum", "stupid", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
THREATS = ("kill", "hurt", "destroy", "beat", "smash", "burn", "töten", "tuer", "matar")
TARGETS = ("you", "your", "u", "he", "she", "they", "them", "this", "that", "these", "those", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "elle", "tú", "usted", "ellos", "esa", "ese")
NEGATIONS = ("not", "no", "never", "nobody", "without", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "quoted", "claimed", "reported", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
HARM = (INSULT, THREAT)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[^.!?;\n\r]+")
#: Words over which a negation or target stays in force, and a threat waits for its target.
REACH, WAIT = 4, 3
#: Factors of arcs: negated, in a reported clause, aimed at a target, a threat without one, after an earlier match.
NEGATED, REPORTED, AIMED, LOOSE, REPEATED = 0.1, 0.1, 1.15, 0.2, 1.1
#: What a target that follows a threat adds, and the weight from which a clause is matched.
FULFILLED, MATCHED = 2.5, 1.0
STEM_SIZES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over ``SYMBOLS``, starting in state 0.

    ``arcs[state][symbol]`` is ``(next state, symbol put out, factor, bonus)``: the arc emits the
    word's weight times the factor, and the bonus.  ``final[state]`` weighs a path that ends there.
    """

    arcs: list[list[tuple[int, int, float, float]]]
    final: list[float]


def transducer(states: list, step: Callable, final: Callable = lambda state: 1.0) -> Transducer:
    """The table of ``step(state, symbol) -> (state, symbol, factor, bonus)`` over all ``states``."""
    number = {state: i for i, state in enumerate(states)}
    arcs = [[(number[to], *rest) for to, *rest in (step(state, symbol) for symbol in SYMBOLS)] for state in states]
    return Transducer(arcs, [final(state) for state in states])


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and puts out what ``second`` makes of its
    output; factors and final weights multiply.  Only states that can be reached are kept."""
    states, arcs = [(0, 0)], []
    number = {(0, 0): 0}
    for a, b in states:  # grows as new states are met
        row = []
        for symbol in SYMBOLS:
            to_a, between, factor_a, bonus_a = first.arcs[a][symbol]
            to_b, out, factor_b, bonus_b = second.arcs[b][between]
            to = (to_a, to_b)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append((number[to], out, factor_a * factor_b, bonus_a * factor_b + bonus_b))
        arcs.append(row)
    return Transducer(arcs, [first.final[a] * second.final[b] for a, b in states])


def report_transducer(factor: float = REPORTED) -> Transducer:
    return transducer([False, True], lambda said, x: (said or x == REPORT, x, 1.0, 0.0), lambda said: factor if said else 1.0)


def negation_transducer(factor: float = NEGATED) -> Transducer:
    def step(left: int, x: int):
        hit = left > 0 and x in HARM  # what is negated is no harm to the transducers after it
        return (REACH if x == NEGATION else max(left - 1, 0)), (OTHER if hit else x), (factor if hit else 1.0), 0.0

    return transducer(list(range(REACH + 1)), step)


def target_transducer(aimed: float = AIMED, loose: float = LOOSE, fulfilled: float = FULFILLED) -> Transducer:
    """States hold for how many words a target is in force, and for how many a threat waits for one."""

    def step(state: tuple[int, int], x: int):
        aim, wait = state
        after = REACH if x == TARGET else max(aim - 1, 0)
        if x == THREAT and not aim:
            return (after, WAIT), x, loose, 0.0
        if x == TARGET and wait:
            return (after, 0), x, 1.0, fulfilled
        return (after, max(wait - 1, 0)), x, (aimed if aim and x in HARM else 1.0), 0.0

    return transducer([(a, w) for a in range(REACH + 1) for w in range(WAIT + 1)], step)


def insult_transducer(repeated: float = REPEATED) -> Transducer:
    return transducer([False, True], lambda met, x: (met or x in HARM, x, (repeated if met and x in HARM else 1.0), 0.0))


def clause_grammar(**factors: float) -> Transducer:
    """Reported speech, negation, target and insult, composed; ``factors`` by the constants' names replace theirs."""
    get = factors.get
    report, negation = report_transducer(get("reported", REPORTED)), negation_transducer(get("negated", NEGATED))
    target = target_transducer(get("aimed", AIMED), get("loose", LOOSE), get("fulfilled", FULFILLED))
    return compose(compose(compose(report, negation), target), insult_transducer(get("repeated", REPEATED)))


CLAUSES = clause_grammar()


@dataclass
class Grammar:
    """A fitted scorer: term and stem weights, and the logistic layer."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    stems: dict[str, tuple[int, float]] = field(default_factory=dict)
    layer: tuple[float, ...] = (-2.0, 1.5, 1.5, 0.5, 0.5)
    clauses: Transducer = CLAUSES

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.words.get(word)
        if got is None:
            got = (OTHER, 0.0)
            for n in STEM_SIZES:
                hit = self.stems.get(word[:n]) if len(word) > n else None
                if hit is not None and hit[1] > got[1]:
                    got = hit
        return got

    def clause(self, words: list[str]) -> float:
        """The weight of a clause's path through the composed grammar."""
        arcs, known = self.clauses.arcs, self.known
        state, total = 0, 0.0
        for word in words:
            symbol, weight = known(word)
            state, _, factor, bonus = arcs[state][symbol]
            if symbol in HARM:
                total += weight * factor
            total += bonus
        return total * self.clauses.final[state]

    def known(self, word: str) -> tuple[int, float]:
        memory = self.__dict__.setdefault("_memory", {})
        got = memory.get(word)
        if got is None:
            if len(memory) > 200_000:
                memory.clear()
            got = memory[word] = self.symbol(word)
        return got

    def harmful(self, text: str) -> bool:
        """Whether a lower-cased text has a word that any clause would match on."""
        safe = self.__dict__.setdefault("_safe", set())
        if len(safe) > 500_000:
            safe.clear()
        for token in set(text.split()) - safe:
            if any(self.symbol(word)[0] in (INSULT, THREAT) for word in WORD.findall(token)):
                return True
            safe.add(token)
        return False

    def features(self, text: str) -> list[float]:
        """Sum, greatest and count of the matched clauses' weights, and their share."""
        text = text.lower()
        if not self.harmful(text):
            return [0.0, 0.0, 0.0, 0.0]
        weights, clauses = [], 0
        for clause in CLAUSE.finditer(text):
            clauses += 1
            emitted = self.clause(WORD.findall(clause[0]))
            if emitted >= MATCHED:
                weights.append(emitted)
        if not weights:
            return [0.0, 0.0, 0.0, 0.0]
        return [math.log1p(sum(weights)), math.log1p(max(weights)), math.log1p(len(weights)), len(weights) / clauses]

    def score(self, text: str) -> float:
        z = self.layer[0] + sum(a * b for a, b in zip(self.layer[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}


def _terms(text: str) -> tuple[set[str], set[str]]:
    words = set(WORD.findall(text.lower()))
    return words, {w[:n] for w in words for n in STEM_SIZES if len(w) > n}


def _odds(on: Counter, off: Counter, n_on: int, n_off: int, least: int, purity: float) -> dict[str, float]:
    """Log-odds of the terms that are frequent and telling enough."""
    found = {}
    for term, a in on.items():
        if a < least:
            continue
        b = off.get(term, 0)
        odds = math.log((a + 0.5) / (n_on + 1)) - math.log((b + 0.5) / (n_off + 1))
        if odds >= purity:
            found[term] = odds
    return found


def count_terms(rows: Iterable[tuple[str, int]]) -> tuple[list[list[Counter]], list[int]]:
    """How many texts of each label hold each word and word beginning, and how many texts there are."""
    counts, n = [[Counter(), Counter()], [Counter(), Counter()]], [0, 0]
    for text, label in rows:
        n[label] += 1
        for kind, terms in enumerate(_terms(text or "")):
            counts[label][kind].update(terms)
    return counts, n


def grammar_of(counts: list[list[Counter]], n: list[int], least: int = 4, purity: float = 2.5, clauses: Transducer = CLAUSES) -> Grammar:
    """The lexicon of counted terms, before the logistic layer is fitted."""
    made = Grammar(clauses=clauses)
    fixed = {w: (k, 1.0) for k, named in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in named}
    made.words = {w: (INSULT, 3.0) for w in INSULTS} | {w: (THREAT, 3.0) for w in THREATS} | fixed
    if not n[0] or not n[1]:
        return made
    words = _odds(counts[1][0], counts[0][0], n[1], n[0], least, purity)
    stems = _odds(counts[1][1], counts[0][1], n[1], n[0], 3 * least, purity)
    for w, odds in words.items():
        if w not in fixed:
            made.words[w] = (THREAT if w in THREATS else INSULT, odds)
    for w in (*INSULTS, *THREATS):  # a given term that occurs but tells nothing is worth little
        if w not in words and counts[0][0][w] + counts[1][0][w] >= least:
            made.words[w] = (made.words[w][0], 0.2)
    made.stems = {s: (INSULT, odds) for s, odds in stems.items()}
    return made


def fit_grammar(rows: Iterable[tuple[str, int]], least: int = 4, purity: float = 2.5, clauses: Transducer = CLAUSES) -> Grammar:
    """A grammar from texts and 0/1 labels."""
    rows = [(text or "", int(label)) for text, label in rows]
    counts, n = count_terms(rows)
    made = grammar_of(counts, n, least, purity, clauses)
    if n[0] and n[1]:
        made.layer = _logistic(np.array([made.features(text) for text, _ in rows]), np.array([label for _, label in rows], float))
    return made


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        penalty = ridge * np.array([0.0, *np.ones(x.shape[1])])
        gradient = x1.T @ (p - y) + penalty * w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``(text, toxic)`` of at most ``max_rows`` labelled rows outside the held-out fold."""
    ids = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "__id is not null and toxic in (0, 1)"
    )
    ids = ids.filter(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0)
    ids = ids.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    found = docs.select(F.col("doc_id").alias("__id"), "text").join(small(ids, 16), "__id")
    return found.groupBy("__id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, least: int = 4, purity: float = 2.5) -> Grammar:
    """The grammar of a bounded sample of labelled rows; the same rows in any order give the same one.

    What reaches the driver are terms that ``least`` or more toxic texts hold, and four
    features of each of the at most ``max_rows`` texts.
    """
    spark = docs.sparkSession
    rows = stash(learning_rows(docs, labels, max_rows), "learning")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        counts, n = count_terms(pairs)
        for kind in (0, 1):
            terms = list(counts[0][kind].keys() | counts[1][kind].keys())
            cells = [[kind] * len(terms), terms, [counts[1][kind][t] for t in terms], [counts[0][kind][t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "term", "on", "off"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([""]), pa.array([n[1]]), pa.array([n[0]])], ["kind", "term", "on", "off"])

    counted = rows.mapInArrow(count, "kind int, term string, on long, off long").groupBy("kind", "term").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    given = F.col("term").isin([*INSULTS, *THREATS])
    counts, n = [[Counter(), Counter()], [Counter(), Counter()]], [0, 0]
    for r in counted.filter((F.col("kind") == 2) | (F.col("on") >= least) | given).collect():
        if r["kind"] == 2:
            n = [r["off"], r["on"]]
        else:
            counts[1][r["kind"]][r["term"]], counts[0][r["kind"]][r["term"]] = r["on"], r["off"]
    made = grammar_of(counts, n, least, purity)
    if not n[0] or not n[1]:
        return made
    shared = spark.sparkContext.broadcast(made)  # bounded: learned from ``max_rows`` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.features(t or "") for t in batch.column(0).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "d", "toxic"])

    table = rows.mapInArrow(features, "a double, b double, c double, d double, toxic int").toArrow()
    found = np.column_stack([table[c].to_numpy() for c in ("a", "b", "c", "d", "toxic")])
    found = found[np.lexsort(found.T)]  # sums of doubles in one order
    made.layer = _logistic(found[:, :4], found[:, 4])
    return made


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; ``held_out`` is false for a null id."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded: learned from ``max_rows`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text("text").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at or above the threshold; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(x or "") < threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
