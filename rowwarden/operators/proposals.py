"""Candidate proposals: default proposer, policy justification, bounded projection.

Shapes used here and in planning:

* results   (run_id, ordinal, check_id, contract_id, table, status, n_failed, ...)
* proposals (proposal_id, run_id, ...)
* actions   (proposal_id, run_id, ordinal, action_id, evidence array<struct<check_id,contract_id>>)

Proposals are untrusted: nothing in an action is believed beyond what the run's failures and
the registry confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import ACTIONS, ERROR, FAIL
from rowwarden.operators.joins import HOT_ROWS, skew_join
from rowwarden.operators.suite import roll_up
from rowwarden.registry import Registry, canonical_json

# Texts of the default proposer.
NO_POLICY = "The check has no reviewed executable policy; record an alert only."
HAS_POLICY = "Request the reviewed action declared by this failed check's policy."
# Why a request is refused, and the bounded reason a plan shows for it.
REFUSALS = {
    "no_evidence": "candidate evidence is invalid for this quality report",
    "unknown_check": "unknown check is not in the quality catalog",
    "not_failed": "candidate evidence is invalid for this quality report",
    "not_governed": "requested action is unsupported by the check policy",
    "not_declared": "requested action is unsupported by the check policy",
    "unbindable": "candidate action is unavailable under the controlled policy",
    "incompatible": "candidate action is unavailable under the controlled policy",
}
# The narrative of a proposal that crosses a durable boundary.
BOUNDED = {
    "root_cause_hypothesis": "Model-authored narrative is not retained in durable task data.",
    "do_not_apply_reason": "Deterministic evaluation and policy compilation are required.",
    "rationale": "Requested for the cited Quality Evidence.",
}


def run_failures(results: DataFrame, registry: Registry) -> DataFrame:
    """(run_id, failed): the run's failed checks as a map check_id -> what may be done about it.

    A map holds at most the declared checks, so it stays small for any number of proposals.
    """
    declared = []
    for spec in registry.checks.values():
        rules = [F.lit(word) for policy in spec.policies for word in (
            policy.action_id, canonical_json(registry.policy_params(spec, policy.action_id)))]
        allowed = F.create_map(*rules) if rules else F.create_map()
        declared += [F.lit(spec.check_id), F.struct(
            F.lit(spec.table).alias("home"), allowed.cast("map<string,string>").alias("rules"))]
    known = F.try_element_at(F.create_map(*declared), F.col("check_id"))
    # one literal per declared check keeps this a plain aggregate, so its size stays estimable
    failed = results.filter(F.col("status") == FAIL).withColumn("__known", known)
    entry = F.struct(
        "contract_id", F.col("__known").isNotNull().alias("declared"),
        F.col("__known")["home"].alias("home"), F.col("__known")["rules"].alias("rules"),
    )
    return failed.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("check_id"), entry))).alias("failed")
    )


def _hit(evidence: Column) -> Column:
    return F.try_element_at(F.col("failed"), evidence["check_id"])


def justify(
    actions: DataFrame,
    results: DataFrame,
    registry: Registry,
    spark: SparkSession,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Actions with ``failed`` (the run's failures), ``refusal`` (null when justified),
    ``params`` and ``home_tables``.

    Evidence must name declared checks that failed in this run under the cited contract; the
    action must be governed, declared by every cited check, and give equal parameters for all.
    The first broken rule is reported; for evidence, the first offending entry. Policies are
    proven bindable when a check is registered, so ``unbindable`` cannot arise from a registry.

    One lookup per action by run: the evidence array is judged in place, without exploding it.
    """
    joined = skew_join(
        actions, run_failures(results, registry), ["run_id"], "left", hot_rows=hot_rows
    )
    declared_ids = F.array(*[F.lit(check_id) for check_id in registry.checks])

    def problem(item: Column) -> Column:
        hit = _hit(item)
        return (
            F.when(hit.isNull() & F.array_contains(declared_ids, item["check_id"]), "not_failed")
            .when(hit.isNull() | ~hit["declared"], "unknown_check")
            .when(~hit["contract_id"].eqNullSafe(item["contract_id"]), "not_failed")
        )

    problems = F.array_compact(F.transform("evidence", problem))
    params = F.transform(
        "evidence", lambda item: F.try_element_at(_hit(item)["rules"], F.col("action_id"))
    )
    judged = joined.withColumn("__problem", F.try_element_at(problems, F.lit(1))).withColumn(
        "__params", params
    )
    distinct = F.array_distinct("__params")
    refusal = (
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no_evidence")
        .when(F.col("__problem").isNotNull(), F.col("__problem"))
        .when(~F.col("action_id").isin(*ACTIONS), "not_governed")
        .when(F.exists("__params", lambda value: value.isNull()), "not_declared")
        .when(F.size(distinct) > 1, "incompatible")
    )
    # staged, so that the verdict is one column and not repeated in every later expression
    return judged.withColumn("refusal", refusal).select(
        *actions.columns,
        "failed",
        "refusal",
        F.when(F.col("refusal").isNull(), F.try_element_at(distinct, F.lit(1))).alias("params"),
        F.array_distinct(F.transform("evidence", lambda item: _hit(item)["home"])).alias("home_tables"),
    )


def blocked_reason(refusal: Column) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(word) for pair in REFUSALS.items() for word in pair]), refusal)


# -- proposer ----------------------------------------------------------------------------


def default_actions(results: DataFrame, registry: Registry, spark: SparkSession) -> DataFrame:
    """One action per failed check of every complete run: its first declared policy, or an
    alert. ``ordinal`` follows registry order."""
    complete = roll_up(results).filter(~F.col("incomplete")).select("run_id")
    first = registry.checks_frame(spark).select("check_id", "default_action")
    return (
        results.filter(F.col("status") == FAIL)
        .join(complete, "run_id", "left_semi")
        .join(F.broadcast(first), "check_id", "left")
        .select(
            "run_id", "ordinal", "check_id",
            F.coalesce("default_action", F.lit("no_op_alert")).alias("action_id"),
            F.array(F.struct("check_id", "contract_id")).alias("evidence"),
            F.when(F.col("default_action").isNull(), NO_POLICY).otherwise(HAS_POLICY).alias("rationale"),
        )
    )


def default_proposals(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The proposal header of every run; its actions come from ``default_actions``."""
    rolled = roll_up(results, runs)
    dirty = F.col("failed") > 0
    pick = lambda incomplete, clean, failing: (
        F.when(F.col("incomplete"), incomplete).when(~dirty, clean).otherwise(failing)
    )
    return rolled.select(
        "run_id",
        pick(F.col("outcome_summary"),
             F.lit("All declared quality checks passed; no remediation is proposed."),
             F.concat(F.col("failed").cast("string"),
                      F.lit(" failed checks have deterministic, allow-listed proposals."))).alias("summary"),
        pick(F.lit("The quality suite did not complete every required check."),
             F.lit("No failed check evidence was provided."),
             F.lit("Seeded or observed rows violate declared table contracts."),
             ).alias("root_cause_hypothesis"),
        pick(F.lit("incomplete quality suite"), F.lit("all checks passed"),
             F.lit("requires evaluation and, for mutations, proposal-level HITL"),
             ).alias("do_not_apply_reason"),
        pick(F.lit(1.0), F.lit(1.0), F.lit(0.9)).alias("confidence"),
        F.when(F.col("incomplete"), 0).otherwise(F.col("failed")).cast("bigint").alias("n_actions"),
    )


def failure_digest(results: DataFrame) -> DataFrame:
    """Per run: outcome text, failed and errored checks as JSON in registry order, no samples."""
    def listed(status: str, *fields: str) -> Column:
        chosen = F.when(F.col("status") == status, F.struct(F.col("ordinal"), F.struct(*fields).alias("item")))
        return F.to_json(F.transform(F.array_sort(F.collect_list(chosen)), lambda x: x["item"]),
                         {"ignoreNullFields": "false"})

    grouped = results.groupBy("run_id").agg(
        listed(FAIL, "check_id", "table", "column", "dimension", "n_failed", "message").alias("failed_checks"),
        listed(ERROR, "check_id", "table", "status", "message").alias("errored_checks"),
    )
    return roll_up(results).select("run_id", "outcome_summary").join(grouped, "run_id")


# -- bounded projection --------------------------------------------------------------------


def bounded_actions(justified: DataFrame) -> DataFrame:
    """Actions of proposals in which every action is justified, rebuilt from registry ids.

    One unjustified action refuses its whole proposal. Contract ids come from the run's
    failures and the rationale is fixed, so no proposer text survives.
    """
    refused = (
        justified.filter(F.col("refusal").isNotNull()).select("proposal_id").distinct()
    )
    kept = skew_join(justified, refused, ["proposal_id"], "left_anti")
    evidence = F.transform("evidence", lambda item: F.struct(
        item["check_id"].alias("check_id"), _hit(item)["contract_id"].alias("contract_id")))
    return kept.select(
        "proposal_id", "run_id", "ordinal", "action_id", evidence.alias("evidence"),
        F.lit(BOUNDED["rationale"]).alias("rationale"),
    )


def bounded_proposals(justified: DataFrame) -> DataFrame:
    """Per proposal with actions: refused or not, and the fixed narrative."""
    counted = justified.groupBy("proposal_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.bool_or(F.col("refusal").isNotNull()).alias("refused"),
    )
    return counted.select(
        "proposal_id", "run_id", "n_actions", "refused",
        F.when(~F.col("refused"), F.concat(
            F.lit("Candidate Proposal contains "), F.col("n_actions").cast("string"),
            F.lit(" governed action request(s)."))).alias("summary"),
        F.when(~F.col("refused"), BOUNDED["root_cause_hypothesis"]).alias("root_cause_hypothesis"),
        F.when(~F.col("refused"), BOUNDED["do_not_apply_reason"]).alias("do_not_apply_reason"),
        F.when(~F.col("refused"), F.lit(0.0)).alias("confidence"),
    )
