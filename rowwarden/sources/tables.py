"""Contracted tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.registry import Registry
from rowwarden.session import config_frame

Reader = Callable[[SparkSession, str], DataFrame]
# The error classes that mean "no such table"; every other error propagates.
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


def parquet_reader(root: str, pattern: str = "{table}.parquet") -> Reader:
    """Tables as Parquet files or directories below ``root``."""
    def read(spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{pattern.format(table=table)}")
    return read


def catalog_reader(registry: Registry) -> Reader:
    """Tables of the session catalog, found by the contract's schema and name."""
    def read(spark: SparkSession, table: str) -> DataFrame:
        return spark.table(registry.contract(table).contract_id)
    return read


def jdbc_reader(registry: Registry, options: Mapping[str, str]) -> Reader:
    """Tables of a database through Spark's JDBC source; partitioning options pass through.

    Filters and column selections are pushed to the database by the source itself.
    """
    def read(spark: SparkSession, table: str) -> DataFrame:
        return (
            spark.read.format("jdbc").options(**options)
            .option("dbtable", registry.contract(table).contract_id).load()
        )
    return read


def load_frames(
    spark: SparkSession, registry: Registry, read: Reader, tables: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """One lazy frame per contract, or per named table. A table that does not exist is left out;
    only schemas are read."""
    frames = {}
    for table in registry.contracts if tables is None else dict.fromkeys(tables):
        try:
            frames[table] = read(spark, table)
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith(ABSENT):
                raise
    return frames


def observed_columns(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, position, column) of every loaded frame."""
    rows = [(t, n, c) for t, frame in frames.items() for n, c in enumerate(frame.columns)]
    return config_frame(spark, rows, "table string, position int, column string")


def observed_schema(spark: SparkSession, registry: Registry,
                    frames: Mapping[str, DataFrame], table: str) -> DataFrame:
    """(position, column, type) of one contracted table."""
    rows = [
        (n, item.name, item.dataType.simpleString())
        for n, item in enumerate(frames[registry.contract(table).table].schema.fields)
    ]
    return config_frame(spark, rows, "position int, column string, type string")


def table_totals(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) of every loaded frame; counts come from file footers."""
    return reduce(
        DataFrame.unionByName,
        [frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table"), "n_rows", F.lit(len(frame.columns)).cast("bigint").alias("n_columns"))
         for t, frame in frames.items()],
    )
