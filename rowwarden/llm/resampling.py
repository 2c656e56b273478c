"""Importance resampling: documents drawn so that they resemble a target table.

Features are runs of words; each falls in the bucket of its CRC-32. A bucket's gain is the log
ratio of its smoothed frequencies in the target and in the source, a document's weight the mean
gain of its features. Gumbel noise that depends on the id only makes the greatest scores a
weighted draw without replacement.

CRC-32 is affine: the checksum of a span is the exclusive or of one contribution per byte, which
depends on the byte and on its distance from the span's end, and of a constant of the length. So
the bytes of all spans of a batch become one array of contributions from a position table, folded
by ``bitwise_xor.reduceat``. Spans longer than the table are cut into blocks counted from their
end, which are folded one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import filled, fresh, query, ragged, received, shipped, slices, table
from rowwarden.session import config_frame, stored

RUN = 1  # words of the longest feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK = 64  # distances in the position table
POLYNOMIAL = 0xEDB88320

ORDINALS = np.arange(256, dtype=np.uint8)
LOWER = np.where((ORDINALS >= 65) & (ORDINALS <= 90), ORDINALS + 32, ORDINALS).astype(np.uint8)
# of the lower-cased bytes: digits, a-z and everything beyond ASCII
WORD_BYTE = ((ORDINALS >= 48) & (ORDINALS <= 57)) | ((ORDINALS >= 97) & (ORDINALS <= 122)) | (ORDINALS >= 128)


def _byte_table() -> np.ndarray:
    """The register after each byte, from a register of zero."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


BYTES = _byte_table()


def _onward(state: np.ndarray, steps: int) -> np.ndarray:
    """Registers after ``steps`` zero bytes."""
    for _ in range(steps):
        state = (state >> 8) ^ BYTES[state & 0xFF]
    return state


def _position_table() -> np.ndarray:
    """Contribution by distance from the end and byte."""
    rows = [BYTES]
    while len(rows) < BLOCK:
        rows.append(_onward(rows[-1], 1))
    return np.stack(rows)


POSITIONS = _position_table()
# the register of all ones after 0, 1, ... BLOCK zero bytes
ONES = np.array([int(_onward(np.array([0xFFFFFFFF], np.uint32), n)[0]) for n in range(BLOCK + 1)], np.uint32)
# what each byte of a register becomes a block later
LATER = np.stack([_onward(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), BLOCK) for k in range(4)])


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exclusive or of the contributions of each span; spans have 1 to BLOCK bytes."""
    if not len(starts):
        return np.empty(0, np.uint32)
    at = ragged(starts, lengths)
    distance = np.repeat(starts + lengths - 1, lengths) - at
    return np.bitwise_xor.reduceat(POSITIONS[distance, data[at]], np.cumsum(lengths) - lengths)


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``data[start:start + length]``; spans may overlap, empty ones give 0."""
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
    out[short] = ~(_folded(data, starts[short], lengths[short]) ^ ONES[lengths[short]])
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        long = long[np.argsort(-lengths[long], kind="stable")]  # those with most blocks first
        blocks = (lengths[long] - 1) // BLOCK + 1
        head = lengths[long] - (blocks - 1) * BLOCK
        state = _folded(data, starts[long], head) ^ ONES[head]
        place = starts[long] + head
        for n in range(1, int(blocks[0])):
            live = int(np.searchsorted(-blocks, -n, side="left"))  # spans with more than n blocks
            old = state[:live]
            later = LATER[0, old & 0xFF] ^ LATER[1, old >> 8 & 0xFF] ^ LATER[2, old >> 16 & 0xFF] ^ LATER[3, old >> 24]
            state[:live] = later ^ _folded(data, place[:live], np.full(live, BLOCK))
            place[:live] += BLOCK
        out[long] = ~state
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z lower-cased, and each text's offset in them (n + 1 values)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return LOWER[raw], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and where each text's words begin among them (n + 1 values)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # a text's end ends a word, and its start may start one
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends - starts, np.searchsorted(starts, bounds)


def feature_buckets(texts: pa.Array, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, where each text's features begin (n + 1 values), and each
    text's number of words. Features are all runs of 1 to ``run`` words, joined by one space."""
    data, bounds = text_bytes(texts)
    starts, lengths, first = words(data, bounds)
    n_words = np.diff(first)
    if run == 1:
        return checksums(data, starts, lengths).astype(np.int64) % buckets, first, n_words
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    new = np.cumsum(lengths + 1) - (lengths + 1)
    joined[ragged(new, lengths)] = data[ragged(starts, lengths)]
    stop = np.repeat(first[1:], n_words)  # behind the last word of the word's text
    begin, size, owner = [], [], []
    for k in range(1, run + 1):
        some = np.flatnonzero(np.arange(len(new)) + k <= stop)
        last = some + k - 1
        begin.append(new[some])
        size.append(new[last] + lengths[last] - new[some])
        owner.append(np.searchsorted(first, some, side="right") - 1)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    found = checksums(joined, np.concatenate(begin)[order], np.concatenate(size)[order]).astype(np.int64) % buckets
    return found, np.searchsorted(owner[order], np.arange(len(n_words) + 1)), n_words


def _counts(run: int, buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(feature_buckets(filled(batch, "text"), run, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    return counted


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``texts`` (text). Tasks send at most one row a bucket."""
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(run, buckets), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed frequencies, floored."""
    all_source, all_target, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain, run: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = received(gain)
        for batch in slices(batches, "text"):
            found, first, n_words = feature_buckets(filled(batch, "text"), run, len(of_bucket))
            n = np.diff(first)
            total = np.diff(np.concatenate(([0], np.cumsum(of_bucket[found])))[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                ["doc_id", "n_words", "n_features", "weight"])
    return weigh


def weights(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs`` (doc_id, text)."""
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _weighed(shipped(docs.sparkSession, gain), run), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) with the greatest
    scores are drawn and ranked from 1; others have a null rank. Ties go to the smaller doc_id, then to
    fewer features, then to either row. Null and empty texts have no feature and weight 0. A row without
    an id has no noise: its score is null, it is not drawn and not one of the N; its features count.
    Repeated rows count and are drawn like others. Without target texts the gains follow from smoothing;
    other columns of either table are not read; an empty table gives no rows.

    Scores are a bounded range of integers, so a histogram of them gives the least score drawn. Only
    rows from there on are sorted: dealt by range, numbered within each range, and moved on by the sizes
    of the ranges before. Equal rows may be dealt to several ranges."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = stored(weights(docs, target, run, buckets).select(
        "*", (F.col("weight") + F.floor(-1000 * F.log(-F.log(chance)))).cast("long").alias("score"),
        F.monotonically_increasing_id().alias("uid")), "scored")
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    sizes = sorted(scored.filter(eligible).groupBy("score").count().collect(), reverse=True)
    drawn = percent * sum(n for _, n in sizes) // 100
    least, above = 0, 0
    for least, n in sizes:
        above += n
        if above >= drawn:
            break
    chosen = eligible & (F.col("score") >= least) if drawn else F.lit(False)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("uid")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(
        scored.filter(chosen).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    before, bases = 0, []
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # one row a partition
        bases.append((row["part"], before))
        before += row["count"]
    bases = config_frame(spark, bases, "part long, base long")
    rank = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = dealt.join(F.broadcast(bases), "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.filter(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns and a new column for the rank.

    Rows are found again by their id, so ids have to be unique."""
    id_, rank = fresh(docs, "id", "rank")
    found = resample(docs, target, **settings).filter("rank is not null").select(F.col("doc_id").alias(id_), F.col("rank").alias(rank))
    return docs.join(found, docs["doc_id"].cast("long") == found[id_]).drop(id_)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {WORDS_SQL} AS words FROM documents),
b AS (SELECT {WORDS_SQL} AS words FROM benchmark),
dw AS (SELECT uid, word, count(*) AS n FROM (SELECT uid, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
crc_of_byte AS MATERIALIZED (
  SELECT list(crc ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
    FROM (SELECT unnest(range(256)) AS byte))),
known AS MATERIALIZED (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_of_byte),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN known USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})
           / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
summed AS (SELECT uid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM dw JOIN known USING (word) JOIN gain USING (bucket) GROUP BY uid),
scored AS (
  SELECT uid, doc_id, coalesce(n, 0) AS n_features, coalesce(floor_div, 0) AS weight,
         coalesce(floor_div, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN (SELECT *, (total - ((total % n) + n) % n) // n AS floor_div FROM summed) USING (uid)),
ranked AS (
  SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS eligible
  FROM scored WHERE n_features >= {LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * eligible // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (uid)
"""


@query("op11_importance_resampling", ORACLE)
def op11(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
