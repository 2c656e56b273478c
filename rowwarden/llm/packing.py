"""Packing documents into sequences by bin completion.

Documents become token pieces of at most ``LIMIT`` ids. Pieces of one length are interchangeable,
so a packing is a list of fillings (how many pieces of which length) with multiplicities, and all
that the search needs is the histogram of lengths: at most ``LIMIT`` rows, whatever the corpus
size. The search runs on the driver over that histogram; the pieces themselves stay distributed.

Search: take the greatest length left, enumerate the undominated fillings of the room beside it
(no chosen piece can be swapped for a greater one that fits, no two for one of their summed length), least waste
first, and branch. The incumbent is best-fit decreasing. A branch is cut when its waste exceeds
what a packing with one sequence less may waste; the search ends at the lower bound
ceil(tokens / LIMIT) or at its budget of nodes, with the best packing so far, and logs which it was.
It is exact only within its budgets: ``MAX_NODES`` or more nodes, ``MAX_STEPS`` steps of a node's
enumeration, which vary the second-greatest length of a sequence first, and ``MAX_FILLINGS`` branches
of a node. A filling is used as often as the pieces allow, never fewer times.

A piece then takes its place by its rank among the pieces of its length. Ranks are counted per
slice of the input and length and added up, so a length that a third of all pieces share is no
single group. Every filling occupies a run of ranks of each of its lengths.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowwarden.llm.base import filled, query, slices, table
from rowwarden.llm.tokens import WordEncoder, token_ids
from rowwarden.session import stored

LIMIT = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SLICES = 4096  # groups of input partitions in which ranks are counted
MAX_NODES = 6_000  # nodes of the search, or
NODES_A_LENGTH = 4  # so many per distinct length, if that is more: one dive may take a node per length
MAX_STEPS = 300  # steps of one enumeration of fillings
MAX_FILLINGS = 8  # branches of one node
SPREAD = 16  # second-greatest lengths that an enumeration takes in turn

LOG = logging.getLogger(__name__)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Filling = tuple[tuple[int, int], ...]  # (length, pieces of it), greatest first
Packing = list[tuple[Filling, int]]  # with multiplicity


def _pieces(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in slices(batches, "text"):
            ids, offsets = token_ids(filled(batch, "text"), encoder, END_ID)
            sizes = np.diff(offsets)
            counts = -(-sizes // limit)
            owner = np.repeat(np.arange(len(sizes)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = number * limit
            length = np.minimum(sizes[owner] - start, limit)
            raw, first = memoryview(ids.tobytes()), (offsets[:-1][owner] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start),
                pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut only beyond ``limit``."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_pieces(tokenizer, limit), PIECES)


def best_fit_decreasing(counts: dict[int, int], limit: int) -> Packing:
    """Each length, greatest first, goes where the least room is left that holds it."""
    open_bins: dict[int, list[tuple[Counter, int]]] = defaultdict(list)  # room: bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, bins in open_bins.items() if bins and r >= length), default=None)
            if room is None:
                fits = limit // length
                full, rest = divmod(left, fits)
                for k, n in ((fits, full), (rest, 1)):
                    if k and n:
                        open_bins[limit - k * length].append((Counter({length: k}), n))
                break
            held, n = open_bins[room].pop()
            used = min(n, left)
            if used < n:
                open_bins[room].append((held, n - used))
            open_bins[room - length].append((held + Counter({length: 1}), used))
            left -= used
    return [(tuple(sorted(held.items(), reverse=True)), n) for bins in open_bins.values() for held, n in bins]


def fillings(counts: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """Undominated fillings of ``room`` as (waste, pieces), least waste first.

    ``counts[x]`` is the number of pieces of length x. Every length may be the greatest of a filling;
    ``SPREAD`` of them are taken in turn, at first evenly spaced ones, and below each the search is
    depth-first over non-increasing lengths. Enumeration stops at enough fillings without waste;
    the greedy filling stands in if none is found before."""
    lengths = np.flatnonzero(counts[:room + 1]).tolist()
    if not lengths:
        return [(room, {})]
    found: list[tuple[int, dict[int, int]]] = []
    steps, exact = 0, 0
    order = list(range(len(lengths), 0, -1))
    spaced = order[::-(-len(order) // SPREAD)]
    waiting = deque(spaced + sorted(set(order) - set(spaced), reverse=True))
    # a stack for each greatest length: the lengths below the index may follow
    turns: deque[list[tuple[int, int, dict[int, int]]]] = deque()
    while (turns or waiting) and steps < MAX_STEPS and exact < MAX_FILLINGS:
        if waiting and len(turns) < SPREAD:
            at = waiting.popleft()
            stack = [(at, room - lengths[at - 1], {lengths[at - 1]: 1})]
        else:
            stack = turns.popleft()
        leaf = False
        while stack and not leaf and steps < MAX_STEPS:
            at, left, chosen = stack.pop()
            steps += 1
            at = min(at, bisect_right(lengths, left))
            while at and counts[lengths[at - 1]] <= chosen.get(lengths[at - 1], 0):
                at -= 1
            if not at:
                leaf = True
                if not _dominated(counts, chosen, left):
                    found.append((left, chosen))
                    exact += not left
                continue
            length = lengths[at - 1]
            stack.append((at - 1, left, chosen))  # later: without this length
            stack.append((at, left - length, {**chosen, length: chosen.get(length, 0) + 1}))
        if stack:
            turns.append(stack)
    return sorted(found or [_greedy(counts, lengths, room)], key=lambda x: (x[0], sum(x[1].values())))[:MAX_FILLINGS]


def _greedy(counts: np.ndarray, lengths: list[int], room: int) -> tuple[int, dict[int, int]]:
    """The filling that takes as many of each length as fit, greatest first."""
    chosen = {}
    for length in reversed(lengths):
        if k := min(int(counts[length]), room // length):
            chosen[length], room = k, room - k * length
    return room, chosen


def _dominated(counts: np.ndarray, chosen: dict[int, int], left: int) -> bool:
    """Is there an unused piece that fits beside, in place of one chosen piece, or equals two of them?"""
    free = counts.copy()
    for length, k in chosen.items():
        free[length] -= k
    held = list(chosen)
    if left and (free[1:left + 1].any() or any(free[x + 1:x + left + 1].any() for x in held)):
        return True
    return any(free[a + b] for n, a in enumerate(held) for b in held[n:] if a != b or chosen[a] > 1)


def complete(counts: dict[int, int], limit: int = LIMIT, max_nodes: int | None = None) -> Packing:
    """The packing of a histogram {length: pieces} found by bin completion."""
    if max_nodes is None:
        max_nodes = max(MAX_NODES, NODES_A_LENGTH * len(counts))
    best = best_fit_decreasing(counts, limit)
    fewest = sum(n for _, n in best)
    tokens = sum(length * n for length, n in counts.items())
    bound = -(-tokens // limit)
    nodes = 0
    start = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        start[length] = n
    # a branch: the pieces before its filling, the filling and its waste, then the sequences, the
    # waste and the linked list of fillings before it
    stack: list[tuple] = [(start, None, 0, 0, 0, None)]
    while stack and fewest > bound and nodes < max_nodes:
        left, filling, spare, used, waste, done = stack.pop()
        if filling is not None:
            times = min(int(left[x]) // k for x, k in filling)
            used, waste, done = used + times, waste + times * spare, (filling, times, done)
        if waste > (fewest - 1) * limit - tokens:
            continue
        if filling is not None:
            left = left.copy()
            for x, k in filling:
                left[x] -= k * times
        some = np.flatnonzero(left)
        if not len(some):
            best, fewest = [], used
            while done is not None:
                best.append(done[:2])
                done = done[2]
            continue
        nodes += 1
        top = int(some[-1])
        others = left.copy()
        others[top] -= 1
        for waste_here, chosen in reversed(fillings(others, limit - top)):  # the least waste is taken up first
            pieces_of = Counter(chosen)
            pieces_of[top] += 1
            stack.append((left, tuple(sorted(pieces_of.items(), reverse=True)), waste_here, used, waste, done))
    LOG.info("%d sequences after %d nodes; the lower bound is %d%s", fewest, nodes, bound, "" if fewest > bound else ", reached")
    return best


def runs(packing: Packing) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), sorted by length and
    rank: pieces of a length, taken by rank, fill one filling's sequences after the other's."""
    taken: Counter = Counter()
    sequence, rows = 0, []
    for filling, times in packing:
        offset = 0
        for length, k in filling:
            rows.append((length, taken[length], sequence, k, offset))
            taken[length] += k * times
            offset += length * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = broadcast.value
        keys = table_[:, 0] << 48 | table_[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table_[np.searchsorted(keys, length << 48 | rank, side="right") - 1] if len(length) else table_[:0]
            nth = rank - row[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in names], pa.array(row[:, 2] + nth // row[:, 3]),
                 pa.array(row[:, 4] + nth % row[:, 3] * length)], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur;
    null ids stay null; other columns are not read; an empty table gives no rows. No piece is
    dropped: a document longer than ``limit`` is cut, each piece placed like any other."""
    cut = stored(pieces(docs, tokenizer, limit).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SLICES))), "pieces")
    tally = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "tally")
    counts = {row["length"]: row["n"] for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    placed = docs.sparkSession.sparkContext.broadcast(runs(complete(counts, limit)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    # bases grow with the input; merging them uses the shuffle that the ranks need anyway
    ranked = cut.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(placed), f"{PIECES}, sequence_id long, offset long")


@query("op5_packing")
def op5(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
