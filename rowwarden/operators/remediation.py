"""Remediation targets: which rows an allowed action copies, fills or leaves alone.

A target is a DataFrame over the current rows; its durable form is a row count and a
fingerprint of the primary keys. Source tables are never changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import ACTIONS, CheckSpec
from rowwarden.functions.fingerprint import empty_set_digest, row_hash, set_digest
from rowwarden.functions.predicates import is_missing, row_predicate, structural_error
from rowwarden.functions.values import fill_literal
from rowwarden.operators.checks import orphan_rows
from rowwarden.operators.digests import grouped_rows
from rowwarden.operators.joins import HOT_ROWS
from rowwarden.operators.verdicts import RowVerdicts, key_text
from rowwarden.registry import Registry
from rowwarden.session import config_frame, forget

Frames = Mapping[str, DataFrame]
# Actions whose targets are the rows matching one condition.
ROW_ACTIONS = ("quarantine_nulls", "quarantine_invalids", "null_fill")


def surplus_rows(rows: DataFrame, keys: list[str], pk: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All but the smallest primary key of every key group; null key parts group together."""
    joined = grouped_rows(rows, keys, {"__keep": F.min(pk)}, hot_rows)
    return joined.filter(F.col(pk) != F.col("__keep")).drop("__keep")


def row_condition(registry: Registry, check_id: str, action_id: str) -> Column | None:
    """The target condition of a row action, None for actions that need a join or no rows."""
    if action_id not in ROW_ACTIONS:
        return None
    spec = registry.check(check_id)
    params = registry.policy_params(spec, action_id)
    return row_predicate(registry, spec) if action_id == "quarantine_invalids" else is_missing(
        params["column"]
    )


def parents_of(params: Mapping[str, str], frames: Frames) -> DataFrame:
    return frames[params["ref_table"]].select(F.col(params["ref_column"]).alias(params["fk_column"]))


def target_rows(registry: Registry, check_id: str, action_id: str, frames: Frames) -> DataFrame | None:
    """Whole target rows of one declared policy; None when the action has no targets."""
    spec = registry.check(check_id)
    params = registry.policy_params(spec, action_id)
    rows = frames[spec.table]
    condition = row_condition(registry, check_id, action_id)
    if condition is not None:
        return rows.filter(condition)
    if action_id == "quarantine_orphans":
        return orphan_rows(rows, params["fk_column"], parents_of(params, frames))
    if action_id == "dedupe_keep_min_pk":
        keys = params["business_key"]
        return surplus_rows(rows, [keys] if isinstance(keys, str) else list(keys), params["pk_column"])
    return None


# -- exact target sets -------------------------------------------------------------------


def label_of(table: str, action_id: str) -> str:
    """What a target fingerprint is bound to besides its keys."""
    return f"{table}|{action_id}"


def readable(registry: Registry, frames: Frames, check_id: str, action_id: str) -> bool:
    """Do the columns exist that a declared policy's targets are found by?"""
    spec = registry.check(check_id)
    params = registry.policy_params(spec, action_id)
    return not _unreadable(registry, spec, params, registry.contract(spec.table).single_key, frames)


def _unreadable(registry: Registry, spec: CheckSpec, params: Mapping, pk: str, frames: Frames) -> bool:
    """Decided from schemas alone, policy by policy, so one dropped column blocks only what names it."""
    seen = {table: frame.columns for table, frame in frames.items()}
    if structural_error(registry, spec, seen) or pk not in seen.get(spec.table, ()):
        return True
    if "ref_table" in params and params["ref_column"] not in seen.get(params["ref_table"], ()):
        return True
    named = [params.get(name) for name in ("column", "fk_column", "pk_column", "business_key")]
    flat = [x for value in named if value for x in ([value] if isinstance(value, str) else value)]
    return any(name not in seen[spec.table] for name in flat)


def target_sets(
    registry: Registry,
    frames: Frames,
    spark: SparkSession,
    requests: Iterable[tuple[str, str]] | None = None,
    verdicts: RowVerdicts | None = None,
) -> DataFrame:
    """(check_id, action_id, table, target_count, target_fingerprint) per requested policy.

    Without ``requests``: every declared policy whose table is loaded. Each table is scanned once, or
    not at all when ``verdicts`` of the policies are given; any number of plans may then refer to
    the result, which has one row per policy. A policy whose targets cannot be resolved is absent:
    its table or a column it names is missing, or a dedupe meets primary keys that are null or repeat.
    """
    if requests is None:
        requests = [(s.check_id, p.action_id) for s in registry.checks.values() for p in s.policies]
    idle: list[tuple[str, str, str]] = []
    asked: list[tuple[str, str]] = []
    for check_id, action_id in dict.fromkeys(requests):
        if action_id in ("no_op_alert", "schema_drift_ticket"):
            idle.append((check_id, action_id, registry.check(check_id).table))
        elif readable(registry, frames, check_id, action_id):
            asked.append((check_id, action_id))
    parts = [config_frame(spark, idle, "check_id string, action_id string, table string").select(
        "*", F.lit(0).cast("bigint").alias("target_count"),
        empty_set_digest(column="concat(`table`, '|', action_id)").alias("target_fingerprint"))]
    if asked:
        own = None if verdicts else RowVerdicts(registry, frames, spark, policies=asked)
        parts.append(_digested(verdicts or own, asked))
        if own:
            forget(own.facts)  # target sets are read from the verdicts
    return reduce(DataFrame.unionByName, parts)


def _digested(verdicts: RowVerdicts, policies: list[tuple[str, str]]) -> DataFrame:
    """Summaries of the target rows. Each row is hashed once per verdict and handed to all its policies."""
    clear = [(c, a, verdicts.registry.check(c).table) for c, a in policies if not verdicts.is_unclear(c, a)]
    # every clear policy is in the result, also one without any target row
    named = config_frame(verdicts.spark, clear, "check_id string, action_id string, table string")
    found = verdicts.targets(policies).select("check_id", "action_id", "table", row_hash(key_text()).alias("__h")).groupBy(
        "check_id", "action_id", "table").agg(
        F.count("__h").alias("target_count"),
        set_digest("__h", column="concat(`table`, '|', action_id)").alias("target_fingerprint"))
    return named.join(found, ["check_id", "action_id", "table"], "left").select(
        "check_id", "action_id", "table", F.coalesce("target_count", F.lit(0)).alias("target_count"),
        F.coalesce("target_fingerprint", empty_set_digest(column="concat(`table`, '|', action_id)")).alias("target_fingerprint"))


def recheck(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Planned target sets against recomputed ones, with ``unchanged``. ``current`` has one row
    per policy; ``planned`` may name a policy for any number of plans. A target that can no longer be computed counts as changed."""
    now = current.select(
        "check_id", "action_id", F.col("target_count").alias("current_count"),
        F.col("target_fingerprint").alias("current_fingerprint"),
    )
    return planned.join(F.broadcast(now), ["check_id", "action_id"], "left").withColumn(
        "unchanged",
        F.coalesce(
            (F.col("target_count") == F.col("current_count"))
            & (F.col("target_fingerprint") == F.col("current_fingerprint")),
            F.lit(False),
        ),
    )


# -- outputs -----------------------------------------------------------------------------


def _copy(rows: DataFrame, registry: Registry, table: str, run_id: str | Column) -> DataFrame:
    """The quarantine form of rows (check_id, action_id, row)."""
    contract = registry.contract(table)
    keep = {"ignoreNullFields": "false"}
    return rows.select(
        "check_id", "action_id", (run_id if isinstance(run_id, Column) else F.lit(run_id)).alias("run_id"),
        F.lit(contract.contract_id).alias("table_name"),
        F.to_json(F.struct(F.col(f"row.{contract.single_key}").alias(contract.single_key)), keep).alias("pk_json"),
        F.col("action_id").alias("reason"), F.to_json("row", keep).alias("payload"),
        row_hash(F.col(f"row.{contract.single_key}")).alias("pk_hash"))


def quarantine_copies(
    registry: Registry, frames: Frames, table: str, policies: Iterable[tuple[str, str]], run_id: str | Column
) -> DataFrame:
    """Copies of the target rows of several policies of one table: (check_id, action_id, run_id, table_name,
    pk_json, reason, payload, pk_hash). All row conditions share one scan, whose rows are handed to
    every policy they fall under; ``pk_hash`` is what target fingerprints are made of."""
    source = frames[table]
    hits, parts = [], []
    for check_id, action_id in policies:
        condition = row_condition(registry, check_id, action_id)
        if condition is not None:
            hits.append(F.when(condition, F.struct(F.lit(check_id).alias("check_id"), F.lit(action_id).alias("action_id"))))
        else:
            found = target_rows(registry, check_id, action_id, frames)
            parts.append(found.select(
                F.lit(check_id).alias("check_id"), F.lit(action_id).alias("action_id"), F.struct(*source.columns).alias("row")))
    if hits:
        exploded = source.select(F.explode(F.array_compact(F.array(*hits))).alias("policy"), F.struct(*source.columns).alias("row"))
        parts.append(exploded.select("policy.check_id", "policy.action_id", "row"))
    return _copy(reduce(DataFrame.unionByName, parts), registry, table, run_id)


def quarantine_rows(
    registry: Registry, check_id: str, action_id: str, frames: Frames, run_id: str | Column, pk_hash: bool = False,
) -> DataFrame | None:
    """Copies of one policy's target rows: (run_id, table_name, pk_json, reason, payload), and with ``pk_hash``
    the hash of the key. None for actions that copy nothing."""
    if action_id == "null_fill" or not ACTIONS[action_id].mutates:
        return None
    copies = quarantine_copies(registry, frames, registry.check(check_id).table, [(check_id, action_id)], run_id)
    return copies.drop("check_id", "action_id", *([] if pk_hash else ["pk_hash"]))


def filled_rows(registry: Registry, check_id: str, frames: Frames, mark: str | None = None) -> DataFrame:
    """The table with nulls of the checked column replaced, as a new frame. ``mark`` names a further
    column that tells the filled rows from the others."""
    spec = registry.check(check_id)
    params = registry.policy_params(spec, "null_fill")
    column = registry.contract(spec.table).column(params["column"])
    value = fill_literal(column, params["fill_value"])
    rows = frames[spec.table] if mark is None else frames[spec.table].withColumn(mark, is_missing(column.name))
    return rows.withColumn(column.name, F.coalesce(F.col(column.name), value))


def notices(results: DataFrame, policies: DataFrame) -> DataFrame:
    """Alert and ticket rows for failed checks whose policy changes nothing."""
    quiet = [name for name, rule in ACTIONS.items() if not rule.mutates]
    chosen = policies.filter(F.col("action_id").isin(*quiet)).select("check_id", "action_id")
    keys = [name for name in ("run_id",) if name in results.columns]
    return results.filter(F.col("status") == "fail").join(F.broadcast(chosen), "check_id").select(
        *keys, "check_id", "action_id", "table", "n_failed", "message"
    )
