"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Adaptive execution sizes shuffles, splits skewed partitions and drops empty branches.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | str = "*", app: str = "rowwarden", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    plain = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        **settings,
    }
    for name, value in plain.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only an unset one is replaced by a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rowwarden-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def config_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], ddl: str) -> DataFrame:
    """Declarations and single results as a DataFrame. Arrow input becomes a local relation, so
    the optimizer knows that it is small; it costs neither a job nor a Python worker."""
    schema = T.StructType.fromDDL(ddl)
    columns = [[row[n] for row in rows] for n in range(len(schema))]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(values, type=kind) for values, kind in zip(columns, arrow.types, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over twice the session's cores by a hash of ``keys``, to be stored. Rows of repeating ids and texts
    take so few bytes that one task would write, and one task read, all that later steps hash and compare."""
    return frame.repartition(2 * frame.sparkSession.sparkContext.defaultParallelism, *keys)


def stored(frame: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write an intermediate table into the shared checkpoint folder and read it back. ``parts`` names
    partition columns, so that later reads touch only the partitions they ask for.

    For results that several later steps use: they are computed once, later plans stay small
    and know the table's size, and the loss of an executor does not start them again.
    """
    spark = frame.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    (frame.write.partitionBy(*parts) if parts else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


# Spark keeps the shuffle files of a finished write until the driver collects its garbage, unless this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_writers: list[str | None] = []  # one entry a write under way; the first has the setting to go back to


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files as they end: nothing reads them but the write itself. So the disk holds
    the shuffles of one write and not those of all writes before it."""
    with _cleaning:
        _writers.append(spark.conf.get(CLEANUP, None) if not _writers else _writers[0])
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _writers.pop()
            if not _writers:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def packed(frame: DataFrame, name: str) -> DataFrame:
    """``stored`` for tables of ids and fingerprints, which are most of what a governed apply keeps on disk. Their hex
    digits repeat no sequence that Snappy could shorten; Zstandard halves them."""
    spark = frame.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    with shuffles_dropped(spark):
        frame.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._packed_at = path
    return found


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``packed`` tables that no step reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame._packed_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/rowwarden/{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete this application's stored tables, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
