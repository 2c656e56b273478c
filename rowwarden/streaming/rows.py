"""Row checks over a stream.

Completeness and validity look at one row at a time, so their columns apply to a stream as they
are. Keyed checks need the whole table and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rowwarden.functions.predicates import row_predicate
from rowwarden.registry import Registry


def failing_stream(registry: Registry, check_id: str, stream: DataFrame) -> DataFrame:
    """Failing rows of one row check, with the id of the check."""
    condition = row_predicate(registry, registry.check(check_id))
    if condition is None:
        raise ValueError(f"{check_id} is not a row check and cannot run on a stream")
    return stream.filter(condition).withColumn("check_id", F.lit(check_id))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only Parquet sink; the checkpoint folder must be shared by the cluster."""
    return rows.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).option("path", path)
