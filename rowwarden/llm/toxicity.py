"""Toxicity: a weighted finite-state grammar over clauses.

Small transducers read a clause word by word: one for insults, one for threats, one for targets
(who is spoken to or of), one for negation with its scope, one for reported speech. Their
composition is one automaton whose final state says what the clause did: insulted somebody, took
an insult back, quoted a threat, and so on. A text is scored by the weighted clauses it matches, not
by the words in it.

What is learned: which words and word stems insult (they occur in toxic texts far more often than
in others), and the weight of each kind of clause. The words of the other transducers, and the
weights that learning starts from, are given.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import bounded_sample, encoded, filled, fold, query, received, shipped, slices, split_words, table
from rowwarden.llm.language import normal

FOLDS = 5
TRAIN_DOCS = 3000  # labelled rows of each class that the grammar is fitted to, the least by hash of their id
TRAIN_CHARS = 20_000  # longest text among them
STEMS = range(4, 8)  # lengths of word beginnings tried as stems
MIN_ODDS, MIN_EVIDENCE = 2.5, 18.0  # of an insult: log odds, and nats against chance
SCOPE = 3  # words that a negation reaches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
BREAKS = ".,;:!?"

# Fixed word lists of the grammar.
WORDS = {
    THREAT: "kill murder hurt stab shoot destroy burn hang töten schlagen umbringen tuer frapper brûler matar golpear quemar".split(),
    TARGET: "you your you're he she they them him her du dich dein ihr sie tu te toi vous ils elles tú vos usted ustedes ellos ellas".split(),
    NEGATION: "not no never isn't don't nicht kein keine nie ne pas jamais non nunca jamás".split(),
    REPORT: "said says wrote called quoted claims sagte schrieb nannte dit écrit appelé dijo escribió llamó".split(),
}

# (insult, threat, target, reported) of a clause -> weight that learning starts from.
# insult: 0 none, 1 denied, 2 asserted; threat: the same.
KINDS = [x for x in product(range(3), range(3), range(2), range(2)) if x[0] or x[1]]
PRIOR = np.array([
    (0.0, 0.5, 4.0)[insult] + (0.0, 0.2, 0.8)[threat] + (0.7 if target and (insult == 2 or threat == 2) else 0.0) - (1.0 if reported else 0.0)
    for insult, threat, target, reported in KINDS])
PRIOR = np.append(PRIOR, 0.5)  # of how densely clauses match
PRIOR_BIAS = -3.0
RIDGE = 0.3  # strength of the pull towards the prior weights


class Transducer:
    """Deterministic: ``step(state, symbol)`` is the next state; 0 is the start."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def with_(self, other: Transducer) -> Transducer:
        """Composition over one input: both read each symbol; the state is the pair."""
        return Transducer(
            (self.start, other.start), lambda state, symbol: (self.step(state[0], symbol), other.step(state[1], symbol)))

    def compiled(self, symbols: int) -> tuple[list, np.ndarray]:
        """Reachable states and their numbered transitions (state, symbol)."""
        states, number, arcs = [self.start], {self.start: 0}, []
        for state in states:  # grows while it is read
            row = []
            for symbol in range(symbols):
                after = self.step(state, symbol)
                if after not in number:
                    number[after] = len(states)
                    states.append(after)
                row.append(number[after])
            arcs.append(row)
        return states, np.array(arcs)


def flag(*symbols: int) -> Transducer:
    """Remembers whether one of the symbols was read."""
    return Transducer(0, lambda state, symbol: int(state or symbol in symbols))


def negatable(what: int) -> Transducer:
    """(denied or asserted, words of scope left): a negation denies ``what`` within its scope."""
    def step(state, symbol):
        level, scope = state
        if symbol == what:
            level = max(level, 1 if scope else 2)
        return level, SCOPE if symbol == NEGATION else max(0, scope - 1)
    return Transducer((0, 0), step)


GRAMMAR = negatable(INSULT).with_(negatable(THREAT)).with_(flag(TARGET)).with_(flag(REPORT))


class Automaton:
    def __init__(self):
        states, self.arcs = GRAMMAR.compiled(6)
        # a state is ((((insult, scope), (threat, scope)), target), reported)
        kinds = [(s[0][0][0][0], s[0][0][1][0], s[0][1], s[1]) for s in states]
        self.kind = [KINDS.index(kind) if kind in KINDS else -1 for kind in kinds]

    def read(self, symbols: list[int]) -> int:
        """Kind of the clause, -1 for none."""
        state = 0
        for symbol in symbols:
            state = self.arcs[state][symbol]
        return self.kind[state]


def stems_of(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) >= n]


def learned_insults(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words and stems (marked ``*``) that set toxic texts apart.

    A copied text repeats its words in one setting, an insult turns up anywhere: a unit counts once
    for each pair of neighbours it has where a toxic text first uses it. Evidence is the
    exponent of Chernoff's bound on its split between the classes by chance."""
    counts = (Counter(), Counter())
    for words, label in zip(texts, toxic.tolist(), strict=True):
        counts[label].update({unit for word in set(words) for unit in (word, *stems_of(word))})
    good, bad = counts
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    chance = n_bad / (n_bad + n_good)

    def telling(unit: str, n: int) -> bool:
        m = good[unit]
        if np.log((n + 0.5) / (n_bad + 1)) - np.log((m + 0.5) / (n_good + 1)) < MIN_ODDS:
            return False
        share = n / (n + m)
        return n * np.log(share / chance) + (m * np.log((1 - share) / (1 - chance)) if m else 0.0) >= MIN_EVIDENCE

    settings: dict[str, set[tuple[str, str]]] = {unit: set() for unit, n in bad.items() if telling(unit, n)}
    for words, label in zip(texts, toxic.tolist(), strict=True):
        first: set[str] = set()
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False) if label else ():
            for unit in (word, *stems_of(word)):
                if unit in settings and unit not in first:
                    first.add(unit)
                    settings[unit].add((before, after))
    return {unit for unit, seen in settings.items() if telling(unit, len(seen))}


class Grammar:
    """The compiled automaton, its lexicon and its weights."""

    def __init__(self, insults: set[str], weights: np.ndarray = PRIOR, bias: float = PRIOR_BIAS):
        self.insults, self.weights, self.bias = insults, weights, bias
        self.given = {word: symbol for symbol, words in WORDS.items() for word in words}

    def symbol(self, word: str) -> int:
        if word in self.insults or any(stem in self.insults for stem in stems_of(word)):
            return INSULT
        return self.given.get(word, OTHER)

    def matched(self, texts: pa.Array) -> np.ndarray:
        """(texts, kinds + 1): which kinds of clauses a text has, and log(1 + matches per 100 words).
        Only clauses with an insult or a threat are read."""
        flat, bounds = split_words(texts)
        raw, codes = encoded(flat)
        counts = np.zeros((len(texts), len(KINDS)))
        if not raw:
            return np.column_stack([counts, counts[:, 0]])
        kinds = np.fromiter((self.symbol(normal(word)) for word in raw), np.int8, len(raw))
        ends = np.fromiter((word[-1] in BREAKS for word in raw), bool, len(raw))
        symbols, closing = kinds[codes], np.flatnonzero(ends[codes])
        automaton, last = Automaton(), (-1, -1)
        for at in np.flatnonzero((symbols == INSULT) | (symbols == THREAT)).tolist():
            text = int(np.searchsorted(bounds, at, side="right")) - 1
            n = int(np.searchsorted(closing, at))
            first = max(int(bounds[text]), int(closing[n - 1]) + 1 if n else 0)
            stop = min(int(bounds[text + 1]), int(closing[n]) + 1 if n < len(closing) else len(codes))
            if (first, stop) != last:
                last = (first, stop)
                counts[text, automaton.read(symbols[first:stop].tolist())] += 1
        return np.column_stack([counts > 0, np.log1p(100 * counts.sum(1) / np.maximum(1, np.diff(bounds)))])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.matched(texts) @ self.weights + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[str, int]], odds: float | None = None) -> Grammar:
    """Fits a grammar to (text, toxic) rows; ``odds`` are the classes' true odds, if they differ."""
    toxic = np.array([label for _, label in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return Grammar(set())
    words = [[w for w in map(normal, text.split()) if w] for text, _ in rows]
    grammar = Grammar(learned_insults(words, toxic))
    seen = grammar.matched(pa.array([text for text, _ in rows]))
    design = np.column_stack([seen, np.ones(len(rows))])
    start = np.append(PRIOR, PRIOR_BIAS)
    weights = start.copy()
    for _ in range(30):  # Newton steps on the ridge-penalised likelihood
        chance = sigmoid(design @ weights)
        slope = design.T @ (toxic - chance) - RIDGE * (weights - start)
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + RIDGE * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights = weights + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
    if odds:
        weights[-1] += np.log(odds) - np.log(toxic.sum() / (1 - toxic).sum())
    return Grammar(grammar.insults, weights[:-1], float(weights[-1]))


def fitted(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar of the labelled rows outside fold 0: a bounded number of each class."""
    known = labels.filter((fold("doc_id", FOLDS) != 0) & F.col("toxic").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = [bounded_sample(known.filter(F.col("toxic") == c), "doc_id", TRAIN_DOCS) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most two classes of TRAIN_DOCS ids
    rows = texts.filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    odds = sizes[1] / sizes[0] if sizes.get(0) and sizes.get(1) else None
    return train([(row["text"], row["toxic"]) for row in rows], odds)


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = received(broadcast)
        for batch in slices(batches, "text"):
            scores = grammar.scores(filled(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) may cover some documents; of repeated labels the greatest counts,
    nulls and other values are ignored. A null or empty text matches no clause and gets the score of
    one. Without labels of both classes nothing is known to insult and the given weights are
    used. A null doc_id is neither held out nor learned from. Repeated rows are scored alike; other
    columns are not read; an empty table gives no rows."""
    grammar = shipped(docs.sparkSession, fitted(docs, labels))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(grammar), "doc_id long, held_out boolean, score double, predicted int")


@query("op3_toxicity")
def op3(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
