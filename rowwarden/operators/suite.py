"""The quality suite: all checks of a registry as one DataFrame.

Each table is scanned once for the columns its rules name (see ``verdicts``); counts and samples
are read from the narrow result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import (
    COMPLETENESS,
    ERROR,
    FAIL,
    PASS,
    REFERENTIAL_INTEGRITY,
    SCHEMA_DRIFT,
    UNIQUENESS,
    VALIDITY,
)
from rowwarden.functions.fingerprint import text_digest
from rowwarden.functions.predicates import structural_error
from rowwarden.operators.checks import SAMPLE_DEFAULT, failing_rows
from rowwarden.operators.verdicts import RowVerdicts, as_text, readable_checks
from rowwarden.registry import Registry
from rowwarden.session import config_frame

Frames = Mapping[str, DataFrame]

# The only fields that may leave a quality run. Samples are not among them.
REPORT_FIELDS = (
    "run_id", "report_id", "fingerprint", "audit_event_id", "generated_at", "checks",
    "observed_columns",
)
CHECK_FIELDS = (
    "check_id", "table", "column", "dimension", "status", "n_failed", "n_total", "message",
    "contract_id", "predicate",
)
COUNTS = "check_id string, n_failed bigint, n_total bigint"


def observed(frames: Frames) -> dict[str, list[str]]:
    return {table: list(frame.columns) for table, frame in frames.items()}


def _drift_names(registry: Registry, table: str, frames: Frames) -> tuple[list[str], list[str], int]:
    expected = set(registry.contract(table).column_names)
    found = set(frames[table].columns) if table in frames else set()
    return sorted(found - expected), sorted(expected - found), len(expected | found)


# The texts of drift results.
def _drift_text(registry: Registry, table: str, frames: Frames) -> str:
    extra, missing, _ = _drift_names(registry, table, frames)
    if table not in frames:
        return f"drift on {table}: missing table {table}"
    if extra or missing:
        return f"drift on {table}: extra={extra} missing={missing}"
    return f"{table} matches contract ({len(registry.contract(table).columns)} columns)"


def _schema_facts(registry: Registry, frames: Frames, errors: Mapping[str, str]) -> list[tuple]:
    """(check_id, n_failed, n_total, status, message) for what schemas alone decide."""
    facts = [(check_id, 0, 0, ERROR, text) for check_id, text in errors.items()]
    for spec in registry.checks.values():
        if spec.dimension == SCHEMA_DRIFT:
            extra, missing, total = _drift_names(registry, spec.table, frames)
            failed = 1 if spec.table not in frames else len(extra) + len(missing)
            facts.append(
                (spec.check_id, failed, total, None, _drift_text(registry, spec.table, frames))
            )
    return facts


# The texts of data checks, whatever table they are about.
def message_column() -> Column:
    """The result text of data checks, from counts and the check's own fields."""
    failed = F.col("n_failed").cast("string")
    by = F.col("dimension")
    return (
        F.when(by == COMPLETENESS, F.concat(
            failed, F.lit("/"), F.col("n_total").cast("string"), F.lit(" null "), F.col("column"),
            F.lit(" on "), F.col("table")))
        .when((by == VALIDITY) & (F.col("contains") == "@"), F.concat(failed, F.lit(" emails missing @")))
        .when((by == VALIDITY) & F.col("window_start").isNotNull(),
              F.concat(failed, F.lit(" visits outside window")))
        .when(by == VALIDITY, F.concat(failed, F.lit(" illegal "), F.col("column"), F.lit(" values")))
        .when(by == UNIQUENESS, F.concat(
            failed, F.lit(" rows share ("), F.array_join("business_key", ", "), F.lit(")")))
        .when(by == REFERENTIAL_INTEGRITY, F.concat(
            failed, F.lit(" orphan "), F.col("column"), F.lit(" on "), F.col("table")))
    )


def run_suite(
    registry: Registry, frames: Frames, spark: SparkSession, verdicts: RowVerdicts | None = None
) -> DataFrame:
    """Exactly one row per declared check, ``ordinal`` giving registry order.

    Columns: ordinal, check_id, table, column, dimension, status, n_failed, n_total, message,
    contract_id, predicate. No row values. ``verdicts`` of all readable checks may be given, and
    then serve samples and target sets as well.
    """
    schemas = observed(frames)
    errors = {}
    for spec in registry.checks.values():
        reason = structural_error(registry, spec, schemas)
        if reason:
            errors[spec.check_id] = reason
    facts = config_frame(
            spark,
            _schema_facts(registry, frames, errors), f"{COUNTS}, forced string, fixed string"
    )
    verdicts = verdicts or RowVerdicts(registry, frames, spark, readable_checks(registry, frames))
    counted = verdicts.counts().select(
        "check_id", F.col("n_failed").cast("bigint"), F.col("n_total").cast("bigint"),
        F.lit(None).cast("string").alias("forced"), F.lit(None).cast("string").alias("fixed"))
    counts = facts.unionByName(counted)
    # both sides hold one row per declared check
    return counts.join(F.broadcast(registry.checks_frame(spark)), "check_id").select(
        "ordinal", "check_id", "table", "column", "dimension",
        F.coalesce("forced", F.when(F.col("n_failed") > 0, FAIL).otherwise(PASS)).alias("status"),
        "n_failed", "n_total",
        F.coalesce("fixed", message_column()).alias("message"),
        "contract_id",
        F.col("description").alias("predicate"),
    )


def failure_samples(
    registry: Registry, frames: Frames, check_ids: Sequence[str] | None = None,
    limit: int = SAMPLE_DEFAULT, verdicts: RowVerdicts | None = None,
) -> DataFrame:
    """Up to ``limit`` failing rows per check as (check_id, row_key, sample JSON).

    Kept apart from results on purpose: samples are row values. The first rows are those with the least
    primary keys. Of a table whose key column is gone, rows are ordered by their JSON text and have an
    empty ``row_key``.
    """
    spark = next(iter(frames.values())).sparkSession
    chosen = [c for c in readable_checks(registry, frames) if check_ids is None or c in check_ids]
    keyed, keyless = [], []
    for check_id in chosen:
        spec = registry.check(check_id)
        known = registry.contract(spec.table).single_key in frames[spec.table].columns
        (keyed if known else keyless).append(check_id)
    parts = [_drift_samples(registry, frames, check_ids, limit, spark)]
    if keyed:
        parts.append((verdicts or RowVerdicts(registry, frames, spark, keyed)).samples(keyed, limit))
    for check_id in keyless:
        rows = failing_rows(registry, check_id, frames)
        body = F.to_json(F.struct(*[as_text(rows, name) for name in rows.columns]), {"ignoreNullFields": "false"})
        parts.append(rows.select(
            F.lit(check_id).alias("check_id"), F.lit("").alias("row_key"), body.alias("sample")).orderBy("sample").limit(limit))
    return reduce(DataFrame.unionByName, parts)


def _drift_samples(
    registry: Registry, frames: Frames, check_ids: Sequence[str] | None, limit: int, spark: SparkSession
) -> DataFrame:
    """Column names that differ from the contract: schemas decide, no table is read."""
    rows = []
    for spec in registry.checks.values():
        if spec.dimension != SCHEMA_DRIFT or (check_ids is not None and spec.check_id not in check_ids):
            continue
        extra, missing, _ = _drift_names(registry, spec.table, frames)
        found = [("extra", name) for name in extra] + [("missing", name) for name in missing]
        if spec.table not in frames:
            found = [("missing_table", spec.table)]
        rows += [(spec.check_id, f"{kind}|{name}", json.dumps({"kind": kind, "column": name}, separators=(",", ":")))
                 for kind, name in found[:limit]]
    return config_frame(spark, rows, "check_id string, row_key string, sample string")


# -- reports: one row per run ------------------------------------------------------------


# The texts of a run's outcome.
def outcome_text(passed: Column, failed: Column, errors: Column) -> Column:
    counts = F.concat(
        passed.cast("string"), F.lit(" passed, "), failed.cast("string"), F.lit(" failed, "),
        errors.cast("string"), F.when(errors == 1, " error").otherwise(" errors"),
    )
    none = (passed + failed + errors) == 0
    return (
        F.when(none, F.concat(F.lit("incomplete: "), counts, F.lit("; no checks ran")))
        .when(errors > 0, F.concat(F.lit("incomplete: "), counts))
        .when(failed > 0, F.concat(F.lit("completed: "), counts))
        .otherwise(F.concat(F.lit("completed: "), counts, F.lit("; all checks passed")))
    )


def roll_up(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: counts, completeness, failing ids in registry order, summary text.

    ``runs`` adds runs without any check. A run has one row per declared check, so the
    collected ids are bounded by the registry.
    """
    is_failed = F.col("status") == FAIL
    rolled = results.groupBy("run_id").agg(
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(is_failed).alias("failed"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
        F.array_sort(
            F.collect_list(F.when(is_failed, F.struct("ordinal", "check_id")))
        ).alias("__failing"),
    )
    if runs is not None:
        rolled = runs.select("run_id").distinct().join(rolled, "run_id", "left").na.fill(
            0, ["passed", "failed", "errors"]
        )
    total = F.col("passed") + F.col("failed") + F.col("errors")
    failing = F.transform(F.coalesce("__failing", F.array()), lambda item: item["check_id"])
    return rolled.select(
        "run_id", "passed", "failed", "errors",
        ((total == 0) | (F.col("errors") > 0)).alias("incomplete"),
        failing.alias("failing_check_ids"),
        outcome_text(F.col("passed"), F.col("failed"), F.col("errors")).alias("outcome_summary"),
    )


def exit_category(rolled: DataFrame, blocked: Column | None = None) -> DataFrame:
    """2 incomplete, 1 failures or a blocked evaluation, 0 clean, with the next step."""
    refused = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    dirty = F.col("failed") > 0
    return rolled.select(
        "*",
        F.when(F.col("incomplete"), 2).when(dirty | refused, 1).otherwise(0).alias("exit_code"),
        F.when(F.col("incomplete"),
               "correct check execution or configuration; do not review a remediation plan")
        .when(dirty, "compile and evaluate a remediation plan from failed checks")
        .otherwise("no remediation is required").alias("next_step"),
    )


def report_fingerprints(results: DataFrame) -> DataFrame:
    """Canonical JSON digest of each run's ids, statuses and counts in registry order.

    Message and samples stay outside. The group is one run of one registry.
    """
    # field order is the sorted key order of the canonical JSON
    entry = F.struct("check_id", "contract_id", "n_failed", "n_total", "status")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ordinal"), entry.alias("entry"))))
    return results.groupBy("run_id").agg(ordered.alias("__ordered")).select(
        "run_id",
        text_digest(F.to_json(F.struct(
            F.transform("__ordered", lambda item: item["entry"]).alias("checks"),
            F.col("run_id").alias("quality_run_id"),
        ))).alias("report_fingerprint"),
    )


def sample_free(frame: DataFrame, allowed: Sequence[str] = CHECK_FIELDS,
                keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keep only reviewed fields; a field nobody reviewed is dropped, not passed on."""
    return frame.select(*[name for name in (*keys, *allowed) if name in frame.columns])


def reconcile(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed failures against expected (check_id, n_expected): full outer, with a verdict."""
    joined = expected.join(results.select("check_id", "n_failed"), "check_id", "full_outer")
    seen, wanted = F.coalesce("n_failed", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    return joined.select(
        "check_id", wanted.alias("n_expected"), seen.alias("n_failed"),
        (seen == wanted).alias("matches"),
    )
