"""Language-model scores: subword lattice likelihood.

The pieces of an existing vocabulary are the edges of a lattice over each word. A text is a
sequence of pieces closed by an end symbol; its probability is the sum over all segmentations,
computed by the forward recursion in log space. No piece crosses a word's begin (``▁``), so the sum
over a text is the product of the sums over its words. Piece probabilities start from the
vocabulary's own ranks and are re-estimated on all training words by expectation-maximisation:
Spark counts the words once, each round adds up expected piece counts over the distinct words,
and what reaches the driver is one number per piece of the vocabulary.

The base score needs every word's corpus count. The ``HEAD`` most frequent words are sent to the tasks
that read the texts; for the others each text contributes (row, word, count) to a join with the
table of counts, summed per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import encoded, filled, fold, query, received, shipped, slices, split_words, table
from rowwarden.llm.tokens import vocabulary
from rowwarden.session import stored

FOLDS, HELD_OUT = 7, 2
VOCABULARY = "piece_bpe_32k.model"
HEAD = 100_000  # words whose counts every task holds
ROUNDS = 3  # of expectation-maximisation
SMOOTHING = 0.1  # added to every piece's expected count
BYTE, END = 0, 1  # edges besides the vocabulary's: one unknown byte, the end of a text
CHUNK = 20_000  # words whose lattices are worked on at once, fewer if they are long
MARK = "▁"
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Pieces:
    """The vocabulary as hash tables by piece: edge 2 + n is piece n."""

    pieces: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, int]]  # hashes, edges, shift
    longest: int

    @classmethod
    def load(cls, name: str = VOCABULARY) -> tuple[Pieces, np.ndarray]:
        """The pieces and their initial probabilities, by rank, bytes and end included."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        ranked = [(model.id_to_piece(n), -model.get_score(n)) for n in range(model.get_piece_size())
                  if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))]
        ranked = [(piece, rank) for piece, rank in ranked if MARK not in piece[1:]]
        start = np.array([1e-6, 1e-3, *[1 / (2 + rank) for _, rank in ranked]])
        return cls.of([piece for piece, _ in ranked]), start / start.sum()

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        hashes = np.empty(len(pieces), np.uint64)
        for n, piece in enumerate(pieces):
            value = 0
            for c in piece:
                value = (value * int(MULTIPLIER) + ord(c) + 1) % (1 << 64)
            hashes[n] = value
        tables, left, bits = [], np.arange(len(pieces)), 20
        while len(left):  # what does not fit one table goes to the next
            shift, keys, edges = 64 - bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            slots = ((hashes[left] * SPREAD) >> np.uint64(shift)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            keys[slots[first]], edges[slots[first]] = hashes[left[first]], left[first] + 2
            tables.append((keys, edges, shift))
            left, bits = np.delete(left, first), bits - 1
        return cls(pieces, tables, max(map(len, pieces), default=0))

    def edges(self, hashes: np.ndarray) -> np.ndarray:
        """Edge of every hash, -1 for none."""
        found = np.full(hashes.shape, -1, np.int32)
        mixed = hashes * SPREAD
        for keys, edges, shift in self.tables:
            slots = (mixed >> np.uint64(shift)).astype(np.int64)
            hit = keys[slots] == hashes
            found[hit] = edges[slots][hit]
        return found

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Groups of words of one length: their numbers; for every piece length k the edges
        (word, begin) or -1; and the bytes of every unknown character (word, begin), else 0.

        A character without a piece of its own is passed byte by byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            n = int(sizes[order[start]])
            stop = min(int(np.searchsorted(sizes[order], n, side="right")), start + max(1, CHUNK * 8 // n))
            group = order[start:stop]
            start = stop
            text = "".join([MARK + words[k] for k in group.tolist()])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n).astype(np.uint64)
            value, by_length = np.zeros_like(codes), []
            for k in range(1, min(self.longest, n) + 1):
                value = value[:, :n - k + 1] * MULTIPLIER + codes[:, k - 1:] + np.uint64(1)
                by_length.append(self.edges(value))
            octets = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            yield group, by_length, np.where(by_length[0] < 0, octets, 0)


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """log of the sum of exponentials, element by element."""
    if len(parts) == 1:
        return parts[0]
    top = parts[0]
    for part in parts[1:]:
        top = np.maximum(top, part)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.exp(parts[0] - safe)
    for part in parts[1:]:
        total += np.exp(part - safe)
    with np.errstate(divide="ignore"):
        return np.log(total) + safe


def forward(pieces: Pieces, log_p: np.ndarray, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word over all segmentations and, given the words' counts, the
    expected number of uses of every edge."""
    scores, expected = np.empty(len(words)), np.zeros(len(log_p))
    padded = np.append(log_p, -np.inf)  # edge -1 is impossible
    for group, by_length, unknown in pieces.lattices(words):
        n = unknown.shape[1]
        weights = [padded[edges] for edges in by_length]
        weights[0] = np.where(unknown > 0, unknown * log_p[BYTE], weights[0])
        used = [k for k, w in enumerate(weights) if k == 0 or np.isfinite(w).any()]
        alpha = [np.zeros(len(group))]
        for j in range(1, n + 1):
            alpha.append(_added([alpha[j - k - 1] + weights[k][:, j - k - 1] for k in used if k < j]))
        scores[group] = alpha[n]
        if counts is None:
            continue
        beta: list[np.ndarray] = [np.zeros(0)] * n + [np.zeros(len(group))]
        for i in range(n - 1, -1, -1):
            beta[i] = _added([weights[k][:, i] + beta[i + k + 1] for k in used if i + k < n])
        for k in used:
            for i in range(n - k):
                chance = np.exp(alpha[i] + weights[k][:, i] + beta[i + k + 1] - alpha[n]) * counts[group]
                edges = by_length[k][:, i]
                known = edges >= 0
                expected += np.bincount(edges[known], chance[known], len(log_p))
                if k == 0:
                    expected[BYTE] += (chance * unknown[:, i]).sum()
    return scores, expected


def normalised(expected: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts. The byte edge's mass is shared by 256 bytes."""
    mass = expected + SMOOTHING
    log_p = np.log(mass / mass.sum())
    log_p[BYTE] -= np.log(256)
    return log_p


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, codes = encoded(split_words(filled(batch, "text"))[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text)."""
    return texts.mapInArrow(_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(words: DataFrame, n: int) -> DataFrame:
    """At most ``n`` words: all those above a count, found from a histogram of log counts."""
    level = F.floor(8 * F.log2("c"))
    sizes = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred rows
    least, taken = None, 0
    for row in sizes:
        taken += row["count"]
        if taken > n:
            break
        least = row["level"]
    return words.filter(level >= least if least is not None else F.lit(False))


def _expected(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p = received(broadcast)
        total = np.zeros(len(log_p))
        for batch in batches:
            total += forward(pieces, log_p, batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["edge", "n"])
    return run


def fitted(words: DataFrame, n_texts: int, name: str = VOCABULARY) -> tuple[Pieces, np.ndarray]:
    """The vocabulary and its log probabilities for the training words (word, c)."""
    pieces, start = Pieces.load(name)
    log_p = np.log(start)
    log_p[BYTE] -= np.log(256)
    for _ in range(ROUNDS):
        model = shipped(words.sparkSession, (pieces, log_p))
        rows = words.mapInArrow(_expected(model), "edge long, n double").groupBy("edge").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(log_p))
        for row in rows:  # at most one per piece
            expected[row["edge"]] = row["n"]
        expected[END] = n_texts
        log_p = normalised(expected)
    return pieces, log_p


ROWS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, word string, tf long"


def _scored(model, head, end_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pieces, log_p), known = received(model), head.value
        for batch in slices(batches, "text"):
            flat, bounds = split_words(filled(batch, "text"))
            words, codes = encoded(flat)
            n, count = batch.num_rows, np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
            word_scores = forward(pieces, log_p, words)[0]
            owner = np.repeat(np.arange(n), np.diff(bounds))
            add = lambda values: np.bincount(owner, values, n)
            tokens = np.diff(bounds) + 1
            in_head = count[codes] > 0
            score = (add(word_scores[codes]) + log_p[END]) / np.log(10)
            logs = add(np.log10(count + 1.0)[codes]) + np.log10(end_count + 1.0)
            n_known = add(in_head).astype(np.int64) + (end_count > 0)
            uid = batch.column("uid")
            yield pa.RecordBatch.from_arrays(
                [uid, batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(n_known), pa.array(logs),
                 pa.array(score), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], pa.schema(FIELDS))
            pairs, tf = np.unique(owner[~in_head] * len(words) + codes[~in_head], return_counts=True)
            if len(pairs):
                none = {kind: pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.bool_(), pa.float64())}
                yield pa.RecordBatch.from_arrays(
                    [uid.take(pa.array(pairs // len(words))), none[pa.int64()], none[pa.bool_()], none[pa.int64()], none[pa.int64()],
                     none[pa.float64()], none[pa.float64()], pa.array(words, pa.string()).take(pa.array(pairs % len(words))),
                     pa.array(tf.astype(np.int64))], pa.schema(FIELDS))
    return run


FIELDS = [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
          ("log_counts", pa.float64()), ("score", pa.float64()), ("word", pa.string()), ("tf", pa.int64())]


def score(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of
    ``docs`` (doc_id, text), both scores as log10 probabilities.

    A null or empty text is the end token alone. Rows outside fold ``HELD_OUT`` are learned from; a null
    doc_id is in no fold: neither held out nor learned from. Without training rows all counts are
    zero and pieces keep the probabilities of their smoothing. Repeated rows count, and are scored,
    as often as they occur; other columns are not read; an empty table gives no rows."""
    context = docs.sparkSession.sparkContext
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = docs.filter(~held_out)
    n_texts = learned.count()
    words = stored(word_counts(learned.select(F.col("text").cast("string").alias("text"))), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = totals["n"] + n_texts, totals["v"] + (n_texts > 0)
    frequent = most_frequent(words, HEAD).toPandas()
    head = context.broadcast(dict(zip(frequent["word"].tolist(), frequent["c"].tolist(), strict=True)))
    model = shipped(docs.sparkSession, fitted(words, n_texts, name))

    scored = stored(rows.mapInArrow(_scored(model, head, n_texts), ROWS), "scored")
    rare = scored.filter("word is not null").select("uid", "word", "tf").join(words, "word")
    rare = rare.groupBy("uid").agg(
        F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    whole = scored.filter("word is null").join(rare, "uid", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
         - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + distinct + 1)))).alias("base_score"), "score")


@query("op10_lm_scoring")
def op10(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
