"""Registry of this package's queries and the helpers its operators share."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Text handled at once inside a task. Bounds a worker's memory whatever the batch size is.
SLICE_BYTES = 6_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in no fold and is never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Working column names that ``docs`` does not use (names compare without case)."""
    used = {name.lower() for name in docs.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` of the rows: those whose ``key`` hashes least.

    The rows are counted first, so that tasks send on only about three times ``n`` rows together
    instead of ``n`` rows each."""
    total, space = rows.count(), 1 << 40
    ranked = rows.withColumn("sample_rank", F.pmod(F.xxhash64(key), F.lit(space)))
    if total > 4 * n:
        ranked = ranked.filter(F.col("sample_rank") < space * 3 * n // total)
    return ranked.orderBy("sample_rank", *rows.columns).limit(n).drop("sample_rank")


def shipped(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that carries this package's classes with it. A plain one names their modules, which
    executors without this repository cannot import."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast) -> Any:
    """The object of ``shipped``, inside a task."""
    return pickle.loads(broadcast.value)


def filled(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls: a null text is an empty text."""
    return pc.fill_null(batch.column(name), "")


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(filled(batch, name)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            base = ends[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts with A-Z lower-cased, and where each text's words begin (n + 1 offsets).

    Words are runs without ASCII white space (0x20, 0x09-0x0D)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # an empty text is split into one empty word
        owner = np.repeat(np.arange(len(counts)), counts)[some]
        counts = np.bincount(owner, minlength=len(counts))
        flat = flat.filter(pa.array(some))
    return flat, np.concatenate(([0], np.cumsum(counts)))


def encoded(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words and the index of every word among them."""
    coded = pc.dictionary_encode(flat)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as the Python worker, such as a loaded tokenizer: a worker
    serves many tasks, and each task unpickles its function anew."""
    home = sys.modules.setdefault("_rowwarden_worker", types.ModuleType("_rowwarden_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
