"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint has 64 bits. Two that differ in at most two bits agree on at least three of five
blocks, so they share the bits of one of the ten choices of three blocks (38 or 39 bits). Texts
with one fingerprint are one class from the start: blocks, links and components see each
fingerprint once, however many copies it has.

A block key shared by up to ``MAX_BLOCK`` fingerprints is compared inside its own row. A fuller
one takes an exact way without pairs: two fingerprints are within two bits if and only if some
value is within one bit of both, so each fingerprint of such a block is linked to the 65 values
around it, and components run over both kinds of vertices. No block is dropped or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden.llm.base import filled, fresh, query, slices, table
from rowwarden.llm.graph import components
from rowwarden.operators.joins import skew_join
from rowwarden.session import stored

SHINGLE = 3
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
SAME_BLOCKS = 3  # of five, when at most two bits differ
DISTANCE = 2
MAX_BLOCK = 64

# bit counts of a byte value: BITS[b, k] is bit k of b
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats count); no word gives zero."""
    words = text.lower().split()  # A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(line, SEED)]
    else:
        ends = list(accumulate(len(word) + 1 for word in words))
        starts = [0, *ends[:-SHINGLE]]
        hashes = [digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1:], strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        prints = np.array([fingerprint(x.as_py()) for x in filled(batch, "text").cast(pa.binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null and empty texts have fp 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long")


def _choice_key(chosen: tuple[int, ...]) -> Column:
    mask = sum(((1 << bits) - 1) << first for first, bits in (BLOCKS[n] for n in chosen))
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _pairs_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside one block of at most MAX_BLOCK fingerprints."""
    for batch in batches:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for members in batch.column("fps"):
            fps = members.values.to_numpy(zero_copy_only=False)
            a, b = np.triu_indices(len(fps), 1)
            close = np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64)) <= DISTANCE
            left.append(fps[a[close]])
            right.append(fps[b[close]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["u", "v"])


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (kind_u, u, kind_v, v) among distinct ``fp`` values whose components are those of
    the relation "differ in at most two bits". Kind 0 is a fingerprint, kind 1 a value one bit
    around it, used only for overfull blocks."""
    choices = list(combinations(range(len(BLOCKS)), SAME_BLOCKS))
    keyed = distinct_fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).cast("byte").alias("choice"), _choice_key(chosen).alias("key"))
        for n, chosen in enumerate(choices)])).alias("k")).select("fp", "k.choice", "k.key")
    full = stored(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    met = skew_join(keyed, full, ["choice", "key"], "inner", sizes=full, hot_rows=MAX_BLOCK * MAX_BLOCK)
    small = met.filter(F.col("n") <= MAX_BLOCK).groupBy("choice", "key").agg(F.collect_list("fp").alias("fps"))
    near = small.select("fps").mapInArrow(_pairs_within, "u long, v long").distinct()
    around = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    crowded = met.filter(F.col("n") > MAX_BLOCK).select("fp").distinct().select(
        "fp", F.explode(F.transform(around, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("value"))
    return near.select(F.lit(0).alias("kind_u"), "u", F.lit(0).alias("kind_v"), "v").unionByName(
        crowded.select(F.lit(0).alias("kind_u"), F.col("fp").alias("u"), F.lit(1).alias("kind_v"), F.col("value").alias("v")))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp): its rows, a number
    of its class, and the least doc_id in the class (null if no row of it has an id)."""
    known = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    vertex = lambda kind, value: F.struct(F.col(kind).alias("kind"), F.col(value).alias("value"))
    edges = links(known.select("fp")).select(vertex("kind_u", "u").alias("u"), vertex("kind_v", "v").alias("v"))
    joined = stored(components(edges).filter("node.kind = 0").select(
        F.col("node.value").alias("fp"), F.col("root.value").alias("root")), "components")  # a root is a fingerprint: kind 0 is least
    grouped = known.join(joined, "fp")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("root_id"))
    many = grouped.select("fp", "root").join(least, "root")
    return known.join(many, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("root_id")).otherwise(F.col("first_id")).alias("component_id"))


def _labelled(prints: DataFrame, known: DataFrame) -> DataFrame:
    """``prints`` with root and component_id. A fingerprint with more rows than a quarter of a shuffle
    partition is matched by broadcast; there are at most four times as many as partitions."""
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows = max(1000, prints.count() // (4 * partitions))
    return skew_join(
        prints, known.drop("n"), ["fp"], "left", null_safe=True, sizes=known.select("fp", "n"), hot_rows=hot_rows)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most two bits.

    Every row of ``docs`` gives a row; repeated rows and equal texts share their class. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id keep
    it and get their class's smallest id, null only if the class has no id. Other columns of
    ``docs``, whatever their names, are not read. An empty table gives an empty result."""
    prints = stored(fingerprints(docs), "fingerprints")
    return _labelled(prints, stored(classes(prints), "labels")).select("doc_id", "fp", "component_id")


def _printed(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(x.as_py()) for x in filled(batch, "text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])
    return run


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of every near-duplicate class of ``docs``, with all columns: the one with the least id.

    Documents are dropped by id, so no text is shuffled while few are. Ids that are null or occur
    more than once do not name a row; those rows are told apart by their fingerprints instead, and
    one of a class stays if none with a smaller id does."""
    prints = stored(fingerprints(docs), "fingerprints")
    known = stored(classes(prints), "labels")
    id_, fp, root, least = fresh(docs, "id", "fp", "root", "component_id")
    unclear = stored(prints.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(id_)), "unclear")
    gone = stored(_labelled(prints, known).filter("doc_id != component_id").select(F.col("doc_id").alias(id_)).distinct(), "gone")
    without = lambda rows, ids, how: rows.join(ids, rows["doc_id"].cast("long").eqNullSafe(ids[id_]), how)
    clear = without(without(docs, unclear, "left_anti"), gone, "left_anti")
    odd = without(docs, unclear, "left_semi").mapInArrow(
        _printed(fp), T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    renamed = known.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least))
    odd = odd.join(renamed, fp).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(least))).dropDuplicates([root])
    return clear.unionByName(odd.select(docs.columns))


@query("op7_simhash")
def op7(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
