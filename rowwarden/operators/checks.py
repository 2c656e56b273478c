"""Failing rows and samples of every check.

Keyed checks (uniqueness, referential integrity) first reduce the table to one row per key and
decide on that; only the keys that fail are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import REFERENTIAL_INTEGRITY, SCHEMA_DRIFT, UNIQUENESS, CheckSpec
from rowwarden.functions.predicates import row_predicate, rule_columns
from rowwarden.operators.digests import grouped_rows, is_exact
from rowwarden.operators.joins import HOT_ROWS, fits_broadcast, in_order, key_groups, skew_join
from rowwarden.registry import Registry
from rowwarden.session import config_frame

Frames = Mapping[str, DataFrame]
SAMPLE_DEFAULT, SAMPLE_MOST = 20, 100  # fixed values: sample size and its upper bound


def no_null(keys: list[str]):
    """All parts of the key are present."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def duplicate_groups(rows: DataFrame, keys: list[str], *, null_groups: bool) -> DataFrame:
    """Keys held by more than one row, with ``n``. A key with a null part groups with its like
    only when ``null_groups`` is set: the suite leaves such rows alone, samples do not."""
    source = rows if null_groups else rows.filter(no_null(keys))
    if not is_exact(rows, keys):
        source = grouped_rows(source.select(*keys), keys, {}, HOT_ROWS)
    return key_groups(source, keys).filter(F.col("n") > 1)


def duplicate_rows(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of a duplicate group, the one with the smallest primary key included."""
    return grouped_rows(rows.filter(no_null(keys)), keys, {}, hot_rows)


def parent_keys(registry: Registry, spec: CheckSpec, frames: Frames) -> DataFrame:
    """The referenced column under the child's column name."""
    column, parent, parent_column = registry.contract(spec.table).foreign_key(spec.column)
    return frames[parent].select(F.col(parent_column).alias(column))


def orphan_groups(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Foreign-key values without a parent, with their row count ``n``; null is one of them.

    Children are counted per value before they meet the parents, so neither a value nor the
    nulls can gather in one task.
    """
    return key_groups(rows, [column]).join(parents, column, "left_anti")


def orphan_rows(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose foreign key is null or has no parent, all columns kept."""
    if fits_broadcast(parents):
        return in_order(rows.join(F.broadcast(parents), column, "left_anti"), rows)
    groups = orphan_groups(rows, column, parents)
    return skew_join(
        rows, groups.select(column), [column], "left_semi", null_safe=True, sizes=groups
    )


def drift_frame(registry: Registry, frames: Frames, spark: SparkSession) -> DataFrame:
    """Differences between contracted and observed column names for all tables at once.

    Rows are (table, kind, column) with kind extra, missing or missing_table. The input is
    schemas only; names are compared, types and order are not.
    """
    expected = registry.columns_frame(spark).select("table", "column", F.lit(True).alias("declared"))
    seen = [(table, name) for table in registry.contracts if table in frames
            for name in frames[table].columns]
    observed = config_frame(spark, seen, "table string, column string").withColumn(
        "found", F.lit(True)
    )
    loaded = config_frame(spark, [(t,) for t in frames], "table string").withColumn(
        "loaded", F.lit(True)
    )
    compared = (
        expected.join(observed, ["table", "column"], "full_outer")
        .join(loaded, "table", "left")
        .filter(F.col("declared").isNull() | F.col("found").isNull())
    )
    absent = F.col("loaded").isNull()
    return compared.select(
        "table",
        F.when(absent, "missing_table")
        .when(F.col("declared").isNull(), "extra")
        .otherwise("missing")
        .alias("kind"),
        F.when(absent, F.col("table")).otherwise(F.col("column")).alias("column"),
    ).distinct()


def failing_rows(registry: Registry, check_id: str, frames: Frames) -> DataFrame:
    """All failing rows of one check, unordered."""
    spec = registry.check(check_id)
    if spec.dimension == SCHEMA_DRIFT:
        spark = next(iter(frames.values())).sparkSession
        drift = drift_frame(registry, frames, spark).filter(F.col("table") == spec.table)
        return drift.select("kind", "column")
    rows = frames[spec.table]
    if spec.dimension == UNIQUENESS:
        return duplicate_rows(rows, list(spec.business_key))
    if spec.dimension == REFERENTIAL_INTEGRITY:
        key = registry.contract(spec.table).single_key
        needed = list(dict.fromkeys([key, spec.column]))
        return orphan_rows(rows.select(*needed), spec.column, parent_keys(registry, spec, frames))
    return rows.filter(row_predicate(registry, spec))


def sample_rows(
    registry: Registry, check_id: str, frames: Frames, limit: int = SAMPLE_DEFAULT
) -> DataFrame:
    """A bounded look at one declared check: key, column and bounds of the first failing rows.

    Uniqueness shows groups with their size, drift the observed columns in order. The order is
    total, so a sample is the same on every run.
    """
    if check_id not in registry.checks:
        raise KeyError(f"check {check_id!r} is not declared")
    if not 1 <= limit <= SAMPLE_MOST:
        raise ValueError(f"limit must be between 1 and {SAMPLE_MOST}")
    spec = registry.check(check_id)
    if spec.dimension == SCHEMA_DRIFT:
        names = frames[spec.table].columns if spec.table in frames else []
        spark = next(iter(frames.values())).sparkSession
        return (
            config_frame(spark, list(enumerate(names)), "position int, column_name string")
            .orderBy("position").limit(limit).select("column_name")
        )
    if spec.dimension == UNIQUENESS:
        keys = list(spec.business_key)
        return (
            duplicate_groups(frames[spec.table], keys, null_groups=True)
            .select(*keys, "n").orderBy(*keys).limit(limit)
        )
    key = registry.contract(spec.table).single_key
    shown = list(dict.fromkeys([key, *rule_columns(spec)]))
    return failing_rows(registry, check_id, frames).select(*shown).orderBy(key).limit(limit)
