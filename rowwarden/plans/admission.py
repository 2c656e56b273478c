"""Admission: time-bounded permission to apply exactly one reviewed, approved plan.

Everything is verified from stored artifacts by joins on their ids; the first broken rule of a
request is its refusal. Artifact tables hold one row per plan, so no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.functions.fingerprint import struct_digest
from rowwarden.operators.joins import by_id, skew_join
from rowwarden.operators.proposals import justify
from rowwarden.operators.suite import report_fingerprints
from rowwarden.plans.compiler import (
    evaluation_fingerprint,
    identity,
    item_digests,
    plan_fingerprint,
    policy_drift,
    short_id,
)
from rowwarden.plans.review import TTL_HOURS, decision_fingerprint, instant, plan_conflicts
from rowwarden.registry import Registry
from rowwarden.session import forget, packed, stored

ADMISSION_FIELDS = (
    "admission_id", "run_id", "plan_id", "plan_fingerprint", "evaluation_id",
    "evaluation_fingerprint", "decision_id", "decision_event_id", "policy_fingerprint",
    "environment_id",
)


def _same(one: str, other: str) -> Column:
    return F.col(one).eqNullSafe(F.col(other))


# -- integrity ----------------------------------------------------------------------------


def admission_fingerprint() -> Column:
    return struct_digest(
        *[F.col(name) for name in ADMISSION_FIELDS],
        instant("issued_at").alias("issued_at"), instant("expires_at").alias("expires_at"))


def report_integrity(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, report_intact): stored report fingerprints against their results."""
    again = report_fingerprints(results).withColumnRenamed("report_fingerprint", "__again")
    return reports.select("run_id", "report_fingerprint").join(again, "run_id", "left").select(
        "run_id", F.coalesce(_same("report_fingerprint", "__again") & F.col("__again").isNotNull(),
                             F.lit(False)).alias("report_intact"))


def plan_integrity(plans: DataFrame, items: DataFrame) -> DataFrame:
    """(plan_id, plan_intact): header and items still give the stored fingerprints. The header is judged before the join,
    so that its fields are not shuffled."""
    again = item_digests(items).select("plan_id", F.col("items_fingerprint").alias("__items"))
    own = plans.select("plan_id", "items_fingerprint", (plan_fingerprint() == F.col("plan_fingerprint")).alias("__header"))
    return by_id(own, again, "plan_id", "left").select("plan_id", (
        (F.coalesce("__items", F.col("items_fingerprint")) == F.col("items_fingerprint"))
        & F.col("__header")).alias("plan_intact"))


def evaluation_integrity(evaluations: DataFrame) -> DataFrame:
    return evaluations.select("plan_id", (
        F.col("evaluation_fingerprint").eqNullSafe(evaluation_fingerprint())
    ).alias("evaluation_intact"))


def decision_integrity(decisions: DataFrame) -> DataFrame:
    return decisions.select("decision_id", (
        F.col("decision_fingerprint").eqNullSafe(decision_fingerprint())).alias("decision_intact"))


def admission_integrity(admissions: DataFrame, plans: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(admission_id, problem): a changed payload, or ids that do not belong together."""
    bound_plan = plans.select(
        "plan_id", F.col("plan_fingerprint").alias("p_fp"), F.col("run_id").alias("p_run"),
        F.col("environment_id").alias("p_env"))
    bound_eval = evaluations.select(
        "plan_id", F.col("evaluation_id").alias("e_id"), F.col("evaluation_fingerprint").alias("e_fp"))
    joined = by_id(by_id(admissions, bound_plan, "plan_id", "left"), bound_eval, "plan_id", "left")
    bound = (
        _same("plan_fingerprint", "p_fp") & _same("run_id", "p_run") & _same("environment_id", "p_env")
        & _same("evaluation_id", "e_id") & _same("evaluation_fingerprint", "e_fp"))
    return joined.select("admission_id", (
        F.when(~F.col("fingerprint").eqNullSafe(admission_fingerprint()),
               "apply admission fingerprint does not match received payload")
        .when(~bound, "admission does not authorize this evaluated plan")).alias("problem"))


def param_problems(
    plans: DataFrame, items: DataFrame, results: DataFrame, registry: Registry, spark: SparkSession
) -> DataFrame:
    """(plan_id, problem) for plans whose executable items no longer follow from the evidence.

    Every item is justified again; parameters and table must come out the same, no request may
    repeat, and a plan that is not blocked must cover all failed checks of its run.
    """
    executable = items.filter(F.col("kind") == "executable")
    again = justify(
        executable.select("plan_id", "run_id", "ordinal", "action_id", "evidence", "table",
                          F.col("params").alias("stored")),
        results, registry, spark)
    per_item = again.select("plan_id", (
        F.when(F.col("refusal").isNotNull(), 1)
        .when(~F.col("home_tables").eqNullSafe(F.array("table")), 1)
        .when(~F.col("params").eqNullSafe(F.col("stored")), 2)).alias("code"))
    repeats = (
        executable.groupBy("plan_id", "action_id", identity(F.col("evidence")).alias("e"))
        .count().filter(F.col("count") > 1).select("plan_id", F.lit(0).alias("code")))
    broken = per_item.filter(F.col("code").isNotNull()).unionByName(repeats).groupBy("plan_id").agg(
        F.min("code").alias("code"))
    failed = results.filter(F.col("status") == "fail").groupBy("run_id").agg(
        F.count_distinct("check_id").alias("due"))
    covered = (
        executable.select("plan_id", F.explode("evidence").alias("e"))
        .select("plan_id", F.col("e")["check_id"].alias("c")).distinct()
        .groupBy("plan_id").agg(F.count(F.lit(1)).alias("covered")))
    headed = skew_join(plans.select("plan_id", "run_id", "blocked"), failed, ["run_id"], "left")
    joined = by_id(by_id(headed, broken, "plan_id", "left"), covered, "plan_id", "left")
    zero = F.lit(0)
    return joined.select("plan_id", (
        F.when(F.col("code") == 0, "duplicate executable action and quality evidence")
        .when(F.col("code") == 1, "Check Policy refused the requested action")
        .when(F.col("code") == 2, "item parameters do not match Check Policy")
        .when(~F.col("blocked") & (F.coalesce("covered", zero) != F.coalesce("due", zero)),
              "plan does not cover every failed check in this quality run")
    ).alias("problem")).filter(F.col("problem").isNotNull())


# -- eligibility ---------------------------------------------------------------------------


# What a decision and the events it names say against it, in the order the rules are looked at.
NOT_APPROVED = "human decision is not an approval"
NO_EVENT = "human decision has no durable audit event"
EVENT_LOST = "human decision audit event was not found"
NO_APPROVAL = "audit event is not a human approval"
OTHER_DECISION = "human decision does not match audit lineage"
OTHER_ACTOR = "human decision actor does not match audit lineage"
CHANGED_DECISION = "human decision fingerprint does not match received payload"
NOT_REVIEWED = "human decision has no reviewed predecessor"
NO_REVIEW = "approval review audit event was not found"
OTHER_REVIEW = "approval review does not belong to this evaluation"


def _first(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """The text of the first broken rule, null when none is; an unknown one is not broken."""
    refusal = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        refusal = F.when(F.coalesce(broken, F.lit(False)), text).otherwise(refusal)
    return refusal


def _seal(*names: str) -> Column:
    """Values to be compared and nothing else, as 32 bytes: joins carry them instead of the ids and fingerprints, which
    take up to six times as many. Nulls equal each other."""
    fields = F.struct(*[F.col(name).cast("string").alias(f"f{n}") for n, name in enumerate(names)])
    return F.unhex(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256))


def decision_lineage(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(decision_id, audit_event_id, decided_at, lineage_problem, v_run, v_plan, v_eval, v_review, bound) of each decision with
    its audit event and the review event before that: the first rule that these break among themselves, blank for none, and
    sealed what the event says of plan, evaluation and review. ``bound``: the decision is about the review its event names.

    What the review event says is compared with the audit event. Whether that fits the plan is an earlier rule, so where
    the plan's rules hold, this is the comparison with the plan."""
    own = decisions.select("decision_id", "decision", "actor", "decided_at", "audit_event_id", F.col("review_fingerprint").isNotNull().alias("reviewed"),
                           _seal("review_fingerprint").alias("d_review"), _seal("decision_fingerprint").alias("d_fp"))
    decided = by_id(own, decision_integrity(decisions), "decision_id").select(
        "*", (~F.col("decision").eqNullSafe(F.lit("Approve"))).alias("unapproved")).drop("decision")
    # an event of another kind is refused for its kind, whatever else it says
    told = lambda column, kind: F.when(F.col("kind") == kind, column)
    approval, shown = "human_approved", "approval_review"
    event = events.select(
        F.col("event_id").alias("audit_event_id"), F.col("kind").alias("v_kind"), F.try_element_at("predecessor_ids", F.lit(1)).alias("previous_id"),
        *[told(column, approval).alias(name) for name, column in (
            ("v_outcome", F.col("decision_outcome")), ("v_decision", F.col("decision_id")), ("v_run", F.col("quality_run_id")),
            ("v_actor", F.col("decision_actor")), ("v_fp", _seal("decision_fingerprint")), ("v_plan", _seal("plan_id", "plan_fingerprint")),
            ("v_eval", _seal("evaluation_id", "evaluation_fingerprint")), ("v_review", _seal("review_fingerprint")))])
    previous = events.select(
        F.col("event_id").alias("previous_id"), F.col("kind").alias("r_kind"), told(_seal("review_fingerprint"), shown).alias("r_review"),
        told(_seal("evaluation_id", "evaluation_fingerprint"), shown).alias("r_eval"))
    no = lambda flag: ~F.coalesce(F.col(flag), F.lit(False))
    linked = packed(by_id(decided, event, "audit_event_id", "left").select(
        "decision_id", "audit_event_id", "decided_at", "v_run", "v_plan", "v_eval", "v_review", "previous_id",
        F.coalesce(F.col("reviewed") & _same("d_review", "v_review"), F.lit(False)).alias("bound"),
        F.coalesce(_first((
            (F.col("unapproved"), NOT_APPROVED),
            (F.coalesce(F.trim("audit_event_id"), F.lit("")) == "", NO_EVENT),
            (F.col("v_kind").isNull(), EVENT_LOST),
            ((F.col("v_kind") != approval) | ~F.col("v_outcome").eqNullSafe(F.lit("Approve")), NO_APPROVAL),
            (~_same("v_decision", "decision_id"), OTHER_DECISION),
            (~_same("v_actor", "actor"), OTHER_ACTOR),
            (no("decision_intact") | ~_same("v_fp", "d_fp"), CHANGED_DECISION),
            (F.col("previous_id").isNull(), NOT_REVIEWED))), F.lit("")).alias("event_problem")), "linked")
    lineage = packed(by_id(linked, previous, "previous_id", "left").select(
        "decision_id", "audit_event_id", "decided_at", "v_run", "v_plan", "v_eval", "v_review", "bound",
        F.when(F.col("event_problem") != "", F.col("event_problem")).otherwise(F.coalesce(_first((
            (~F.col("r_kind").eqNullSafe(F.lit(shown)), NO_REVIEW),
            (~_same("r_review", "v_review") | ~_same("r_eval", "v_eval"), OTHER_REVIEW))), F.lit(""))).alias("lineage_problem")), "lineage")
    forget(linked)
    return lineage


def admission_refusals(
    requests: DataFrame,
    plans: DataFrame,
    items: DataFrame,
    evaluations: DataFrame,
    decisions: DataFrame,
    reviews: DataFrame,
    events: DataFrame,
    reports: DataFrame,
    results: DataFrame,
    registry: Registry,
    spark: SparkSession,
    ttl_hours: float = TTL_HOURS,
) -> DataFrame:
    """Every request (plan_id, decision_id, issued_at) with ``refusal``, null when admissible,
    ``expires_at`` and the fields of an admission.

    One join of all artifacts would hold the shuffles of all of them on disk at once, with rows that grow at each step. So
    what decisions say and what the items say are found first, each by a write of its own that leaves narrow rows."""
    plan = plans.select(
        "plan_id", "run_id", "plan_fingerprint", "policy_fingerprint", "environment_id", "blocked")
    drifted = policy_drift(items, registry).groupBy("plan_id").agg(F.bool_or("drifted").alias("drifted"))
    params = param_problems(plans, items, results, registry, spark).withColumnRenamed(
        "problem", "param_problem")
    judged = evaluations.select(
        "plan_id", "evaluation_id", "evaluation_fingerprint", F.col("passed").alias("eval_passed"),
        _seal("plan_fingerprint").alias("eval_plan"))
    shown = reviews.select("plan_id", _seal("review_fingerprint").alias("shown_review"))
    conflicts = plan_conflicts(items).select("plan_id", "conflict")
    lineage = decision_lineage(decisions, events)
    asked = packed(by_id(requests, lineage, "decision_id", "left"), "asked")
    forget(lineage)
    found = [packed(facts, name) for name, facts in (
        ("plan_integrity", plan_integrity(plans, items)), ("drifted", drifted), ("param_problems", params), ("conflicts", conflicts))]
    # one run may hold very many plans, so its report is not joined by a plain shuffle
    headed = skew_join(plan, stored(report_integrity(reports, results), "report_integrity"), ["run_id"], "left")
    joined = asked
    # all by plan, so that the rows are shuffled and sorted by it once
    for facts in (headed, *found, judged, evaluation_integrity(evaluations), shown):
        joined = by_id(joined, facts, "plan_id", "left")
    expires = F.col("decided_at") + F.make_dt_interval(hours=F.lit(int(ttl_hours)), secs=F.lit(
        round((ttl_hours - int(ttl_hours)) * 3600, 6)))
    no = lambda flag: ~F.coalesce(F.col(flag), F.lit(False))
    # a request without its decision has no approval
    said = lambda text: (F.coalesce("lineage_problem", F.lit(NOT_APPROVED)) == text, text)
    # fixed values: the texts, in the order the rules are looked at
    refusal = _first((
        (F.col("run_id").isNull(), "remediation plan was not found"),
        (no("report_intact"), "quality report fingerprint does not match received payload"),
        (no("plan_intact"), "remediation plan fingerprint does not match received payload"),
        (F.col("blocked"), "remediation plan is blocked"),
        (F.coalesce("drifted", F.lit(False)), "policy snapshot drifted after evaluation"),
        (F.col("param_problem").isNotNull(), F.col("param_problem")),
        (no("eval_passed"), "remediation-plan evaluation did not pass"),
        (no("evaluation_intact"), "evaluation fingerprint does not match received payload"),
        (~F.col("eval_plan").eqNullSafe(_seal("plan_fingerprint")),
         "evaluation does not belong to this remediation plan"),
        *[said(text) for text in (NOT_APPROVED, NO_EVENT, EVENT_LOST, NO_APPROVAL, OTHER_DECISION)],
        (~_same("v_run", "run_id"), "human decision does not belong to this quality run"),
        (~F.col("v_plan").eqNullSafe(_seal("plan_id", "plan_fingerprint")),
         "human decision does not belong to this remediation plan"),
        *[said(text) for text in (OTHER_ACTOR, CHANGED_DECISION)],
        (~F.col("v_eval").eqNullSafe(_seal("evaluation_id", "evaluation_fingerprint")),
         "human decision does not belong to this evaluation"),
        (no("bound") | ~_same("v_review", "shown_review"), "human decision does not bind the reviewed plan"),
        *[said(text) for text in (NOT_REVIEWED, NO_REVIEW, OTHER_REVIEW)],
        (F.col("decided_at") > F.col("issued_at"),
         "human decision timestamp is after admission time"),
        (expires <= F.col("issued_at"), "apply admission has expired"),
        (F.col("conflict").isNotNull(), F.col("conflict")),
    ))
    checked = packed(joined.select(
        "plan_id", "decision_id", refusal.alias("refusal"), "run_id", "plan_fingerprint",
        "evaluation_id", "evaluation_fingerprint", "policy_fingerprint", "environment_id",
        F.col("audit_event_id").alias("decision_event_id"), "issued_at", expires.alias("expires_at")), "refusals")
    forget(asked, *found)
    return checked


def admit(checked: DataFrame) -> DataFrame:
    """Admissions of the requests that were not refused."""
    admitted = checked.filter(F.col("refusal").isNull()).withColumn(
        "admission_id", short_id(F.lit("admission"), F.col("plan_id"), F.col("decision_id")))
    return admitted.withColumn("fingerprint", admission_fingerprint()).select(
        *ADMISSION_FIELDS, "issued_at", "expires_at", "fingerprint")
