"""Language identification: a linear-chain conditional random field over words.

Every word with a letter is labelled with a language. Its features are affixes (character n-grams
tied to the word's begin or end), the other character n-grams, the word itself, and membership in
the lexicons of frequent words; transitions between neighbours are learned with them. Training
sequences splice short runs of words from different documents, so the model learns how a
language persists and how text switches. Labelling is the exact forward-backward recursion over
the whole text, for many texts at once. A text's language is the one with the greatest mean
posterior over its words, and that mean is its score.

The model is fitted on the driver to a bounded sample of labelled rows, drawn so that no language is
missing from it; the texts are labelled by Spark tasks, each row alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import encoded, filled, fold, query, received, shipped, slices, split_words, table

FOLDS = 5  # rows of fold 0 are held out
TRAIN_DOCS = 3000  # labelled rows the model is fitted to, about, drawn by hash of their id
RARE_DOCS = 6000  # of rare languages more are drawn: about this many rows over all languages,
LEAST_DOCS = (20, 200)  # but of each language at least and at most so many, or all it has
TRAIN_CHARS = 20_000  # longest text among them
SEQUENCES, SEQUENCE_WORDS, BATCH, EPOCHS = 5000, 64, 250, 4
RUN_WORDS = (3, 32)  # words between switches in a training sequence
LEXICON = 400  # words of each language's lexicon
BUCKETS = 1 << 16  # hashed n-gram and word features
RATE, DECAY = 0.25, 1e-6
CHUNK = 16_000  # words whose features are worked on at once
UNKNOWN = "und"
MIN_SCORE = 0.5  # documents below it are rejected by the filter

PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
EDGE = 1  # code point put before and after each word
ORDERS = (2, 3, 4)  # n-grams; of four only those at an edge


def normal(word: str) -> str:
    """The word in lower case without what surrounds its letters; empty without a letter."""
    if word.isalpha():
        return word.lower()
    first = next((n for n, c in enumerate(word) if c.isalpha()), None)
    if first is None:
        return ""
    last = next(n for n in range(len(word), 0, -1) if word[n - 1].isalpha())
    return word[first:last].lower()


def features(words: list[str], lexicons: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and the word each belongs to."""
    edge = chr(EDGE)
    codes = np.frombuffer(edge.join(["", *words, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1  # of each word's leading edge; the trailing one is the next word's
    owner_of = np.repeat(np.arange(len(words)), sizes + 1)  # of every position but the last edge
    end = begin + sizes + 1
    ids, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = value[:len(codes) - n + 1] * PRIMES[0] + codes[n - 1:] * PRIMES[1]
        if n not in ORDERS or not len(value):
            continue
        at = np.arange(min(len(value), len(owner_of)))
        keep = at + n - 1 <= end[owner_of[at]]
        if n == max(ORDERS):
            keep &= (at == begin[owner_of[at]]) | (at + n - 1 == end[owner_of[at]])
        at = at[keep]
        mixed = (value[at] + PRIMES[2] * np.uint64(n)) * PRIMES[3]
        ids.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner_of[at])
    if len(words):
        # the word itself: a polynomial of all its characters
        powers = PRIMES[2] ** (np.arange(len(codes)) - np.concatenate((np.repeat(begin, sizes + 1), [0]))).astype(np.uint64)
        whole = np.add.reduceat((codes * powers)[:-1], begin) * PRIMES[3]
        ids.append((whole >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(np.arange(len(words)))
    member = [(BUCKETS + k, n) for n, word in enumerate(words) if word in lexicons for k in lexicons[word]]
    ids.append(np.array([k for k, _ in member], np.uint64))
    owners.append(np.array([n for _, n in member], np.int64))
    ids, owners = np.concatenate(ids).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


@dataclass
class Model:
    labels: list[str]
    lexicons: dict[str, list[int]] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (features, labels)
    moves: np.ndarray | None = None  # (from, to), log scale

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every label for every word; each word has a feature, its own."""
        parts = [np.zeros((0, len(self.labels)), np.float32)]
        for first in range(0, len(words), CHUNK):
            some = words[first:first + CHUNK]
            ids, owners = features(some, self.lexicons)
            parts.append(np.add.reduceat(self.weights[ids], np.searchsorted(owners, np.arange(len(some)))))
        return np.concatenate(parts)


def posteriors(potentials: np.ndarray, codes: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of every label at every position, by forward-backward over all sequences at once.

    ``potentials`` (words, labels) are positive; sequence n has positions bounds[n]:bounds[n + 1].
    Positions are taken in step, longest sequences first, so the active ones are a prefix."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    forward = np.empty((len(codes), potentials.shape[1]), np.float32)
    belief = None
    for t in range(longest):
        at = starts[:active[t]] + t
        local = potentials[codes[at]]
        belief = local if belief is None else (belief[:active[t]] @ moves) * local
        belief = belief / belief.sum(1, keepdims=True)
        forward[at] = belief
    back = np.ones((len(sizes), potentials.shape[1]), np.float32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if t + 1 < longest:
            m = active[t + 1]
            ahead = (potentials[codes[at[:m] + 1]] * back[:m]) @ moves.T
            back[:m] = ahead / ahead.sum(1, keepdims=True)
        forward[at] *= back[:n]
    return forward / forward.sum(1, keepdims=True)


def _spliced(documents: list[tuple[np.ndarray, int]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences: word numbers and labels, (sequences, words)."""
    words = np.empty((SEQUENCES, SEQUENCE_WORDS), np.int64)
    labels = np.empty_like(words)
    for row in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            codes, label = documents[rng.integers(len(documents))]
            n = min(int(rng.integers(*RUN_WORDS)), SEQUENCE_WORDS - at, len(codes))
            first = int(rng.integers(len(codes) - n + 1))
            words[row, at:at + n], labels[row, at:at + n] = codes[first:first + n], label
            at += n
    return words, labels


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fits the field to (text, language) rows by AdaGrad on the conditional likelihood."""
    labels = sorted({lang for _, lang in rows})
    model = Model(labels)
    numbers: dict[str, int] = {}
    documents, seen = [], [Counter() for _ in labels]
    for text, lang in rows:
        words = [w for w in map(normal, text.split()) if w]
        if words:
            label = labels.index(lang)
            seen[label].update(words)
            documents.append((np.array([numbers.setdefault(w, len(numbers)) for w in words]), label))
    if not documents:
        return Model([])
    for label, counts in enumerate(seen):
        for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            model.lexicons.setdefault(word, []).append(label)
    vocabulary, size = list(numbers), len(labels)
    model.weights = np.zeros((BUCKETS + size, size))
    model.moves = np.zeros((size, size))
    squares, move_squares = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    rng = np.random.default_rng(seed)
    words, wanted = _spliced(documents, rng)
    for _ in range(EPOCHS):
        for rows_of in np.array_split(rng.permutation(SEQUENCES), SEQUENCES // BATCH):
            used, codes = np.unique(words[rows_of], return_inverse=True)
            codes, gold = codes.reshape(-1), wanted[rows_of].reshape(-1)
            ids, owners = features([vocabulary[n] for n in used], model.lexicons)
            scores = np.add.reduceat(model.weights[ids], np.searchsorted(owners, np.arange(len(used))))
            potentials = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + 1e-12
            bounds = np.arange(0, len(codes) + 1, SEQUENCE_WORDS)
            moves = np.exp(model.moves).astype(np.float32)
            expected = posteriors(potentials, codes, bounds, moves)
            miss = -expected.astype(np.float64)
            miss[np.arange(len(gold)), gold] += 1
            by_word = np.stack([np.bincount(codes, miss[:, k], len(used)) for k in range(size)], 1)
            step = np.stack([np.bincount(ids, by_word[owners, k], len(model.weights)) for k in range(size)], 1) / BATCH
            step -= DECAY * model.weights
            squares += step * step
            model.weights += RATE * step / np.sqrt(squares)
            # transitions: seen pairs less the pairs expected from neighbouring posteriors
            pair = _pairs(potentials, codes, expected, moves)
            gold = gold.reshape(-1, SEQUENCE_WORDS)
            seen_pairs = np.bincount((gold[:, :-1] * size + gold[:, 1:]).reshape(-1), minlength=size * size).reshape(size, size)
            step = (seen_pairs - pair) / BATCH
            move_squares += step * step
            model.moves += RATE * step / np.sqrt(move_squares)
    model.weights = model.weights.astype(np.float32)
    return model


def _pairs(potentials: np.ndarray, codes: np.ndarray, marginals: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions of equally long sequences. A pair's posterior is the forward belief
    times move, potential and backward belief; both beliefs are recomputed in step."""
    size = potentials.shape[1]
    local = potentials[codes].reshape(-1, SEQUENCE_WORDS, size).astype(np.float64)
    ahead = np.ones_like(local)
    for t in range(SEQUENCE_WORDS - 2, -1, -1):
        ahead[:, t] = (local[:, t + 1] * ahead[:, t + 1]) @ moves.T
        ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
    total, belief = np.zeros((size, size)), None
    for t in range(SEQUENCE_WORDS - 1):
        belief = local[:, t] if belief is None else (belief @ moves) * local[:, t]
        belief = belief / belief.sum(1, keepdims=True)
        joint = belief[:, :, None] * moves[None] * (local[:, t + 1] * ahead[:, t + 1])[:, None, :]
        total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return total


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    flat, bounds = split_words(texts)
    raw, codes = encoded(flat)
    shapes = [normal(word) for word in raw]
    numbers: dict[str, int] = {}
    number = np.fromiter((numbers.setdefault(w, len(numbers)) if w else -1 for w in shapes), np.int64, len(shapes))
    codes = number[codes] if len(codes) else np.empty(0, np.int64)
    lettered = codes >= 0
    bounds = np.concatenate(([0], np.cumsum(lettered)))[bounds]
    codes = codes[lettered]
    languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(np.diff(bounds))
    if not len(some) or not model.labels:
        return languages, scores
    emitted = model.emissions(list(numbers))
    potentials = np.exp(emitted - emitted.max(1, keepdims=True)) + np.float32(1e-12)
    marginals = posteriors(potentials, codes, bounds, np.exp(model.moves).astype(np.float32))
    means = np.add.reduceat(marginals.astype(np.float64), bounds[:-1][some]) / np.diff(bounds)[some, None]
    best = means.argmax(1)
    for n, label, mean in zip(some.tolist(), best.tolist(), means[np.arange(len(some)), best].tolist(), strict=True):
        languages[n], scores[n] = model.labels[label], min(mean, 1.0)
    return languages, scores


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of the rows of ``docs`` that the model is fitted to, from rows outside fold 0.

    A row is drawn if the hash of its id is below its language's threshold, which lets through about
    the same share of all languages, ``TRAIN_DOCS`` rows together, and of each about ``LEAST_DOCS`` rows
    at least, so a language that only one row in a million has is learned. Ids are counted, not
    rows: a repeated row counts once."""
    labelled = docs.filter(
        (fold("doc_id", FOLDS) != 0) & F.col("lang").isNotNull() & F.length("text").between(1, TRAIN_CHARS)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # as many rows as languages
    sizes = {row["lang"]: max(row["n"], 1) for row in labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not sizes:
        return []
    total, space = sum(sizes.values()), 1 << 40
    least = max(LEAST_DOCS[0], min(LEAST_DOCS[1], RARE_DOCS // len(sizes)))
    limits = docs.sparkSession.createDataFrame(
        [(lang, int(space * min(1.0, max(TRAIN_DOCS / total, least / n)))) for lang, n in sizes.items()], "lang string, below long")
    drawn = labelled.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.col("below"))
    rows = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return [(row["text"], row["lang"]) for row in sorted(rows, key=lambda row: (row["doc_id"], row["lang"]))]


def fitted(docs: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text, lang). Its size grows with the number of languages."""
    return train(training_rows(docs))


def _label(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(broadcast)
        for batch in slices(batches, "text"):
            languages, scores = predict(filled(batch, "text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    A null or empty text, one without letters, and any text when no labelled row exists to learn
    from, gives ``und`` with score 0. A null lang is not learned from; a null doc_id is neither held
    out nor learned from. Repeated rows are labelled alike; other columns are not read; an empty
    table gives no rows."""
    model = shipped(docs.sparkSession, fitted(docs))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_label(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _recognised(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(broadcast)
        for batch in slices(batches, "text"):
            texts = filled(batch, "text")
            if model.labels:
                yield batch.filter(pa.array(predict(texts, model)[1] >= MIN_SCORE))
            else:
                yield batch.filter(pa.array([any(map(str.isalpha, text)) for text in texts.to_pylist()], pa.bool_()))
    return run


def recognised_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of at least ``MIN_SCORE``.

    Without any labelled row to learn from no language can be recognised; then every row whose text
    has a letter stays. Null texts and texts without letters score 0 and go; repeated rows stay or go alike, and so do rows without
    an id, which are never learned from. Between equally likely languages the first in order counts. All columns stay, whatever
    their names; an empty table gives an empty one."""
    model = shipped(docs.sparkSession, fitted(docs))
    return docs.mapInArrow(_recognised(model), docs.schema)


@query("op2_language_id")
def op2(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
