"""Audit events and table lineage.

Events carry ids, counts, statuses and fingerprints only. ``event_frame`` fixes their shape, so
a sample column cannot slip in: what is not in ``EVENT_FIELDS`` is not an event field.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import bare_name
from rowwarden.functions.fingerprint import struct_digest
from rowwarden.operators.joins import skew_join
from rowwarden.plans.compiler import short_id
from rowwarden.registry import Registry
from rowwarden.session import stored

# Event kinds in the order of a run's life.
EVENT_KINDS = (
    "quality_report", "candidate_proposal", "plan_compiled", "plan_blocked", "evaluation",
    "approval_review", "human_approved", "human_rejected", "human_timed_out", "dry_run",
    "apply_succeeded", "apply_failed",
)
STAGE = {kind: stage for stage, kinds in enumerate((
    ("quality_report",), ("candidate_proposal",), ("plan_compiled", "plan_blocked"),
    ("evaluation",), ("approval_review",), ("human_approved", "human_rejected", "human_timed_out"),
    ("dry_run", "apply_succeeded", "apply_failed"))) for kind in kinds}
CHAIN_LENGTH = 7  # fixed value: stages from report to apply
EVENT_FIELDS = {
    "kind": "string", "quality_run_id": "string", "predecessor_ids": "array<string>",
    "report_id": "string", "report_fingerprint": "string", "proposal_id": "string",
    "candidate_fingerprint": "string", "plan_id": "string", "plan_fingerprint": "string",
    "policy_fingerprint": "string", "target_count": "bigint", "target_set_fingerprint": "string",
    "evaluation_id": "string", "evaluation_fingerprint": "string", "review_fingerprint": "string",
    "decision_id": "string", "decision_fingerprint": "string", "decision_outcome": "string",
    "decision_actor": "string", "decision_note": "string", "apply_result_id": "string",
    "apply_result_fingerprint": "string",
    "apply_steps": "array<struct<action_id:string,table:string,estimated_rows:bigint,rowcount:bigint>>",
    "reasons": "array<string>",
}
# Field names that would carry row content into a durable body.
PRIVATE_FIELDS = ("sample_failures", "sample", "payload", "pk_json", "prompt", "row", "rows")


def event_frame(rows: DataFrame, kind: Column, **given: str) -> DataFrame:
    """Events from artifact rows: ``given`` maps event fields to source columns or expressions.

    The id is derived from the content, so recomputing or replaying a job yields the same
    event, which the sink then recognises.
    """
    columns = [kind.alias("kind")]
    for name, kind_of in list(EVENT_FIELDS.items())[1:]:
        value = F.expr(given[name]) if name in given else F.lit(None)
        if name in ("predecessor_ids", "apply_steps", "reasons") and name not in given:
            value = F.array()
        columns.append(value.cast(kind_of).alias(name))
    shaped = rows.select(*columns)
    body = struct_digest(*[F.col(name) for name in EVENT_FIELDS])
    return shaped.withColumn("fingerprint", body).withColumn(
        "event_id", short_id(F.col("fingerprint")))


def report_events(reports: DataFrame) -> DataFrame:
    """``reports``: run_id, report_id, report_fingerprint."""
    return event_frame(reports, F.lit("quality_report"), quality_run_id="run_id",
                       report_id="report_id", report_fingerprint="report_fingerprint")


def candidate_events(candidates: DataFrame) -> DataFrame:
    """``candidates``: run_id, proposal_id, candidate_fingerprint, previous_id."""
    return event_frame(candidates, F.lit("candidate_proposal"), quality_run_id="run_id",
                       predecessor_ids="array(previous_id)", proposal_id="proposal_id",
                       candidate_fingerprint="candidate_fingerprint")


def plan_events(plans: DataFrame) -> DataFrame:
    """``plans``: plan roll-up with previous_id (the candidate event)."""
    return event_frame(
        plans, F.when(F.col("blocked"), "plan_blocked").otherwise("plan_compiled"),
        quality_run_id="run_id", predecessor_ids="array(previous_id)", plan_id="plan_id",
        plan_fingerprint="plan_fingerprint", policy_fingerprint="policy_fingerprint",
        target_count="target_count", target_set_fingerprint="target_set_fingerprint",
        reasons="blocked_reasons")


def evaluation_events(evaluated: DataFrame) -> DataFrame:
    """``evaluated``: evaluations with previous_id (the plan event)."""
    return event_frame(
        evaluated, F.lit("evaluation"), quality_run_id="run_id",
        predecessor_ids="array(previous_id)", plan_id="plan_id", plan_fingerprint="plan_fingerprint",
        evaluation_id="evaluation_id", evaluation_fingerprint="evaluation_fingerprint",
        reasons="transform(filter(scores, s -> not s.passed), s -> concat(s.name, ': ', s.rationale))")


def review_events(reviews: DataFrame) -> DataFrame:
    """``reviews``: approval reviews with previous_id (the evaluation event)."""
    return event_frame(
        reviews, F.lit("approval_review"), quality_run_id="run_id",
        predecessor_ids="array(previous_id)", plan_id="plan_id", plan_fingerprint="plan_fingerprint",
        policy_fingerprint="policy_fingerprint", evaluation_id="evaluation_id",
        evaluation_fingerprint="evaluation_fingerprint", review_fingerprint="review_fingerprint")


def decision_events(decisions: DataFrame) -> DataFrame:
    """``decisions``: recorded decisions bound to plan, evaluation and review, with previous_id."""
    kind = F.when(F.col("decision") == "Approve", "human_approved").when(
        F.col("decision") == "Timeout", "human_timed_out").otherwise("human_rejected")
    return event_frame(
        decisions, kind, quality_run_id="run_id", predecessor_ids="array(previous_id)",
        plan_id="plan_id", plan_fingerprint="plan_fingerprint", evaluation_id="evaluation_id",
        evaluation_fingerprint="evaluation_fingerprint", review_fingerprint="review_fingerprint",
        decision_id="decision_id", decision_fingerprint="decision_fingerprint",
        decision_outcome="decision", decision_actor="actor", decision_note="note",
        reasons="array(concat('decision_fingerprint=', decision_fingerprint))")


def apply_events(applied: DataFrame, outcome: str) -> DataFrame:
    """``applied``: results with their plan, evaluation and decision ids, steps and reasons."""
    if outcome not in ("dry_run", "apply_succeeded", "apply_failed"):
        raise ValueError(f"unknown apply outcome {outcome!r}")
    return event_frame(
        applied, F.lit(outcome), quality_run_id="run_id", predecessor_ids="array(previous_id)",
        plan_id="plan_id", plan_fingerprint="plan_fingerprint",
        policy_fingerprint="policy_fingerprint", evaluation_id="evaluation_id",
        evaluation_fingerprint="evaluation_fingerprint", decision_id="decision_id",
        apply_result_id="apply_result_id", apply_result_fingerprint="result_fingerprint",
        apply_steps="steps", reasons="reasons")


# -- reading events ------------------------------------------------------------------------


def find_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events of the requested ids; an id without an event stays as a row of nulls."""
    return wanted.select("event_id").distinct().join(events, "event_id", "left")


def chain_problems(events: DataFrame) -> DataFrame:
    """(event_id, problem) of events whose predecessors do not support them.

    A decision needs a review, a review an evaluation, an evaluation a plan, a plan a candidate,
    a candidate a report; the predecessor must exist in the same run and agree on fingerprints.
    """
    wanted = (
        F.when(F.col("kind").isin("human_approved", "human_rejected", "human_timed_out"), "approval_review")
        .when(F.col("kind") == "approval_review", "evaluation")
        .when(F.col("kind") == "evaluation", "plan")
        .when(F.col("kind").isin("plan_compiled", "plan_blocked"), "candidate_proposal")
        .when(F.col("kind") == "candidate_proposal", "quality_report"))
    previous = events.select(
        F.col("event_id").alias("previous_id"),
        F.when(F.col("kind").startswith("plan_"), "plan").otherwise(F.col("kind")).alias("p_kind"),
        F.col("quality_run_id").alias("p_run"),
        *[F.col(name).alias(f"p_{name}") for name in (
            "plan_fingerprint", "evaluation_fingerprint", "review_fingerprint")])
    # explode_outer keeps events that name no predecessor at all; one report may be the
    # predecessor of very many candidates
    linked = skew_join(
        events.withColumn("wanted", wanted).filter(F.col("wanted").isNotNull()).select(
            "*", F.explode_outer("predecessor_ids").alias("previous_id")),
        previous, ["previous_id"], "left")
    agrees = F.lit(True)
    for name in ("plan_fingerprint", "evaluation_fingerprint", "review_fingerprint"):
        known = F.col(f"p_{name}").isNotNull() & F.col(name).isNotNull()
        agrees = agrees & (~known | (F.col(name) == F.col(f"p_{name}")))
    problem = (
        F.when(F.col("previous_id").isNull(), "no predecessor")
        .when(F.col("p_kind").isNull(), "predecessor not found")
        .when(F.col("p_kind") != F.col("wanted"), "predecessor has the wrong kind")
        .when(F.col("p_run") != F.col("quality_run_id"), "predecessor belongs to another run")
        .when(~agrees, "predecessor fingerprints differ"))
    return linked.select("event_id", "kind", problem.alias("problem")).filter(
        F.col("problem").isNotNull())


def walk_runs(events: DataFrame) -> DataFrame:
    """(root_id, quality_run_id, event_id, kind, depth): every event reached from its run's report, by every path.

    Ancestors are found by doubling: a link to the predecessor joined with itself gives links to the second, those joined
    with all so far give the third and fourth, and so on, so a chain of ``CHAIN_LENGTH`` stages takes
    log2 of it joins. Links stay inside a run. An event whose predecessors are lost, or only lead round in a circle, reaches no
    report. One report may be the ancestor of very many events: links know when they have reached one, and are joined no further.
    """
    known = events.select("event_id", "kind", "quality_run_id")
    reports = known.filter(F.col("kind") == "quality_report")
    linked = events.select("event_id", "kind", "quality_run_id", F.explode("predecessor_ids").alias("ancestor"), F.lit(1).alias("depth"))
    roots = reports.select(F.col("event_id").alias("ancestor"), "quality_run_id", F.lit(True).alias("top")).distinct()
    reach = stored(skew_join(linked, roots, ["ancestor", "quality_run_id"], "left").withColumn(
        "top", F.coalesce("top", F.lit(False))), "links1")
    far = 1
    while far < CHAIN_LENGTH - 1:
        onward = reach.filter(F.col("depth") == far).select(
            F.col("event_id").alias("ancestor"), "quality_run_id", F.col("ancestor").alias("beyond"), F.col("top").alias("beyond_top"))
        farther = reach.filter(~F.col("top")).join(onward, ["ancestor", "quality_run_id"]).select(
            "event_id", "kind", "quality_run_id", F.col("beyond").alias("ancestor"), (F.col("depth") + far).alias("depth"),
            F.col("beyond_top").alias("top"))
        far *= 2
        reach = stored(reach.unionByName(farther), f"links{far}")
    found = reach.filter(F.col("top") & (F.col("depth") < CHAIN_LENGTH))
    return reports.select(F.col("event_id").alias("root_id"), "quality_run_id", "event_id", "kind", F.lit(0).alias("depth")).unionByName(
        found.select(F.col("ancestor").alias("root_id"), "quality_run_id", "event_id", "kind", "depth"))


def ordered_run(events: DataFrame, run_id: str) -> DataFrame:
    """All events of one run in the order report, candidate, plan, evaluation, review, decision,
    apply."""
    stage = F.create_map(*[F.lit(x) for pair in STAGE.items() for x in pair])
    return events.filter(F.col("quality_run_id") == run_id).withColumn(
        "stage", F.try_element_at(stage, F.col("kind"))).orderBy("stage", "event_id")


def privacy_findings(bodies: DataFrame, body: str = "body",
                     fields: Iterable[str] = PRIVATE_FIELDS) -> DataFrame:
    """Rows whose JSON body, at any depth, has a field that may carry row content.

    The body is parsed and written again, so that an escaped name becomes the name it stands for, and every quote
    inside a name or value is escaped: only a field's name stands between plain quotes before a colon. What
    is no JSON, or repeats a name, is searched as it is."""
    written = F.coalesce(F.expr(f"to_json(try_parse_json(`{body}`))"), F.col(body))
    return bodies.filter(written.rlike(r'(?<!\\)"(' + "|".join(fields) + r')"\s*:'))


# -- table lineage ----------------------------------------------------------------------------


def foreign_key_edges(registry: Registry, spark: SparkSession) -> DataFrame:
    """(source, target, kind) edges from parents to children, as contracted."""
    return registry.foreign_keys_frame(spark).select(
        F.col("ref_table").alias("source"), F.col("table").alias("target"), F.lit("fk").alias("kind")
    ).distinct()


def neighbours(edges: DataFrame, table: str | None = None) -> DataFrame:
    """(table, direction, neighbour) for one table, or for all of them."""
    out = edges.select(F.col("source").alias("table"), F.lit("downstream").alias("direction"),
                       F.col("target").alias("neighbour"))
    into = edges.select(F.col("target").alias("table"), F.lit("upstream").alias("direction"),
                        F.col("source").alias("neighbour"))
    both = out.unionByName(into)
    return both if table is None else both.filter(F.col("table") == bare_name(table))
