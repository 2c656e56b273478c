"""Benchmark decontamination: which documents contain which test items.

Containment of an item in a document is the share of the item's distinct five-word shingles that
the document has. An item of n shingles is contained at 0.8 or more only if at least ceil(0.8 n)
of them occur, so of any n - ceil(0.8 n) + 1 of its shingles one occurs. Items are partitioned by
size; the sketch of an item holds that many of its least hash values (bottom-k MinHash), so long
documents need no sketch of their own, which would lose a short item inside them. A document that
meets a sketch value is a candidate, and candidates are verified on the shingles themselves:
the search misses nothing and reports nothing false.

Items are searched in blocks of a bounded number of sketch values, each a bounded broadcast;
every block runs over all documents, and no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import encoded, filled, query, slices, split_words, table

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8_000_000  # text of the items that one pass over the documents looks for
SPREAD = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def needed(n: int) -> int:
    """Shingles of ``n`` that must occur for a containment of at least 0.8, without rounding."""
    return -(-n * 4 // 5)


def hashed(flat: pa.Array, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of ``size`` words and the offsets of each text's shingles.

    The hash is a polynomial over the words' XXH64, so equal shingles have equal hashes; a text
    with fewer words has none."""
    words, codes = encoded(flat)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[codes]
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    starts = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.zeros(len(starts), np.uint64)
    for k in range(size):
        value = (value ^ of_word[starts + k]) * SPREAD
        value ^= value >> np.uint64(29)
    return value, np.concatenate(([0], np.cumsum(counts)))


def shingles(words: list[str], size: int = SHINGLE) -> list[str]:
    return [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def sketches(items: list[tuple[int, str]]) -> list[dict]:
    """The partitions of the items, by words of a shingle and size class: sketch values with the items they
    belong to, sorted by value, and the fewest shingles that a text must have to contain one of them.

    An item of one to four words is one shingle of all its words. In a partition of 5-word shingles sizes differ by less than a
    factor of two, so a text too short for its smallest item is not probed at all."""
    parts: dict[tuple[int, int], list] = {}
    for item_id, text in items:
        flat, offsets = split_words(pa.array([text], pa.string()))
        words = flat.to_pylist()
        if words:
            size = min(len(words), SHINGLE)
            own = frozenset(shingles(words, size))
            parts.setdefault((size, len(own).bit_length()), []).append((item_id, own, np.unique(hashed(flat, offsets, size)[0])))
    out = []
    for (size, _), members in sorted(parts.items()):
        kept = [least[:len(own) - needed(len(own)) + 1] for _, own, least in members]
        values, owners = np.concatenate(kept), np.repeat(np.arange(len(members)), list(map(len, kept)))
        order = np.argsort(values, kind="stable")
        out.append({
            "size": size, "ids": [item_id for item_id, _, _ in members], "sets": [own for _, own, _ in members],
            "values": values[order], "owners": owners[order], "fewest": min(needed(len(own)) for _, own, _ in members)})
    return out


def matches(flat: pa.Array, offsets: np.ndarray, parts: list[dict]) -> list[tuple[int, int, int, int]]:
    """(text, item id, shared shingles, shingles of the item) of all texts and items with enough in common."""
    out, known = [], {}
    for part in parts:
        size, values = part["size"], part["values"]
        if not len(flat):
            break
        if size not in known:
            known[size] = hashed(flat, offsets, size)
        value, bounds = known[size]
        long_enough = np.repeat(np.diff(bounds) >= part["fewest"], np.diff(bounds))
        places = np.flatnonzero(long_enough)
        first = np.searchsorted(values, value[places], side="left")
        met_here = values[np.minimum(first, len(values) - 1)] == value[places]
        hit, first = places[met_here], first[met_here]
        text = np.searchsorted(bounds, hit, side="right") - 1
        last = np.searchsorted(values, value[hit], side="right")
        met: dict[int, set[int]] = {}
        for t, a, b in {(int(t), int(a), int(b)) for t, a, b in zip(text, first, last, strict=True)}:
            met.setdefault(t, set()).update(part["owners"][a:b].tolist())
        for t, owners in met.items():
            own = set(shingles(flat.slice(offsets[t], offsets[t + 1] - offsets[t]).to_pylist(), size))
            for at in owners:
                wanted = part["sets"][at]
                shared = len(wanted & own)
                if shared >= needed(len(wanted)):
                    out.append((t, part["ids"][at], shared, len(wanted)))
    return out


def _search(probe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = probe.value
        for batch in slices(batches, "text"):
            flat, offsets = split_words(filled(batch, "text"))
            found = matches(flat, offsets, parts)
            if not found:
                continue
            rows, ids, shared, sizes = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column("doc_id"), pa.array(rows, pa.int64())), pa.array(ids, pa.int64()),
                pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array([n / size for n, size in zip(shared, sizes, strict=True)], pa.float64()),
            ], ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])
    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text; they pass through the driver one at a time."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator()
    block, size = [], 0
    for item_id, text in rows:
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every pair at 0.8 or more.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Words are
    runs without ASCII white space, A-Z lower-cased. An item with one to four words is one
    shingle of all its words, and is found wherever these words stand in a row. Null and empty
    texts contain nothing and are contained nowhere. Repeated rows and null ids are reported as
    they are. Without documents or items the result is empty."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = spark.createDataFrame([], COLUMNS)
    for n, block in enumerate(_blocks(items)):
        probe = spark.sparkContext.broadcast(sketches(block))
        found = texts.mapInArrow(_search(probe), COLUMNS)
        result = found if n == 0 else result.unionByName(found)
    return result


def _clean(probe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, offsets = split_words(filled(batch, "text"))
            dirty = np.zeros(batch.num_rows, bool)
            dirty[[found[0] for found in matches(flat, offsets, probe.value)]] = True
            yield batch.filter(pa.array(~dirty))
    return run


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns unchanged.

    Null and empty texts contain nothing and stay; repeated rows stay or go alike; ids are not looked at, and columns may have
    any names. Without items, or without documents, ``docs`` comes back as it is."""
    for block in _blocks(items):
        probe = docs.sparkSession.sparkContext.broadcast(sketches(block))
        docs = docs.mapInArrow(_clean(probe), docs.schema)
    return docs


ORACLE = r"""
WITH t AS (
  SELECT 'd' AS kind, row_number() OVER () AS row_id, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')
  FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS size FROM t WHERE kind = 'i' AND len(w) > 0),
p AS (SELECT kind, row_id, id, w, least(len(w), 5) AS size FROM t WHERE kind = 'i' AND len(w) > 0
      UNION ALL SELECT kind, row_id, id, w, size FROM t, k WHERE kind = 'd'),
s AS (SELECT DISTINCT kind, row_id, id, size, array_to_string(w[i:i + size - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM p WHERE len(w) >= size)),
n AS (SELECT row_id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY row_id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM s d JOIN s i ON d.g = i.g AND d.size = i.size AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.row_id = i.row_id
GROUP BY d.row_id, d.id, i.row_id, i.id, n_shingles HAVING 5 * count(*) >= 4 * n_shingles
"""


@query("op9_decontamination", ORACLE)
def op9(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
