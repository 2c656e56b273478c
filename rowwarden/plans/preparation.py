"""From audited candidates to reviews: verify, compile, evaluate, review, and record each step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.operators import lineage
from rowwarden.operators.joins import HOT_ROWS, by_id, skew_join
from rowwarden.operators.suite import report_fingerprints
from rowwarden.plans import compiler, review
from rowwarden.plans.compiler import short_id
from rowwarden.registry import Registry
from rowwarden.session import spread, stored


@dataclass(frozen=True)
class Prepared:
    plans: DataFrame
    items: DataFrame
    evaluations: DataFrame
    reviews: DataFrame
    events: DataFrame


def prepare_reviews(
    proposals: DataFrame, actions: DataFrame, results: DataFrame, targets: DataFrame,
    registry: Registry, spark: SparkSession, environment_id: str,
    ttl_hours: float = review.TTL_HOURS, hot_rows: int = HOT_ROWS,
) -> Prepared:
    """The whole sequence for all proposals. Each stage's events name the stage before as their
    predecessor, by ids that follow from content, so all events can be written in one append.
    Artifacts that several stages read are stored once, in the shared checkpoint folder."""
    fingerprints = report_fingerprints(results)
    reports = lineage.report_events(fingerprints.withColumn(
        "report_id", short_id(F.lit("report"), F.col("run_id").cast("string"))))
    roots = reports.select(F.col("quality_run_id").alias("run_id"), F.col("event_id").alias("previous_id"))
    keyed = proposals.select("proposal_id", F.col("run_id").cast("string").alias("run_id"))
    candidates = by_id(skew_join(keyed, roots, ["run_id"], "inner", hot_rows=hot_rows),
                       compiler.candidate_fingerprints(actions), "proposal_id", "left")
    proposed = stored(lineage.candidate_events(candidates), "candidate_events")
    items = stored(spread(compiler.compile_items(
        proposals, actions, results, targets, registry, spark, hot_rows), "plan_id"), "items")
    plans = stored(spread(compiler.roll_up_plans(
        proposals, actions, results, items, environment_id, hot_rows), "plan_id"), "plans")
    by_proposal = proposed.select("proposal_id", F.col("event_id").alias("previous_id"))
    compiled = stored(lineage.plan_events(by_id(plans.withColumn(
        "proposal_id", F.col("proposal_id").cast("string")), by_proposal, "proposal_id")), "plan_events")
    judged = stored(spread(compiler.evaluations(
        plans, compiler.evaluate_plans(plans, items, registry)), "plan_id"), "evaluations")
    evaluated = stored(lineage.evaluation_events(_after(judged, compiled)), "evaluation_events")
    reviews = stored(spread(review.approval_reviews(
        plans, judged, review.review_items(items, registry, spark), ttl_hours), "plan_id"), "reviews")
    reviewed = lineage.review_events(_after(reviews, evaluated))
    events = reduce(DataFrame.unionByName, (reports, proposed, compiled, evaluated, reviewed))
    return Prepared(plans, items, judged, reviews, events)


def _after(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    return by_id(rows, earlier.select("plan_id", F.col("event_id").alias("previous_id")), "plan_id")
