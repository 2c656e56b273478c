"""Scores of candidate proposals: one long table for any number of proposals.

Every proposal gets the same named scores; it passes when all of them do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import ACTIONS
from rowwarden.operators.joins import HOT_ROWS, skew_join
from rowwarden.operators.proposals import justify
from rowwarden.operators.suite import roll_up
from rowwarden.registry import Registry

# Default thresholds, in the order scores are reported.
THRESHOLDS = {
    "schema_validity": 1.0,
    "citation_quality": 0.8,
    "groundedness": 0.8,
    "destructive_risk": 1.0,
    "allowlist_compliance": 1.0,
    "check_policy": 1.0,
    "suite_completeness": 1.0,
}
# Identifiers with destructive meaning, and the slug rule.
DESTRUCTIVE = "DROP|TRUNCATE|ALTER|DELETE"
SLUG = r"(?U)\A\S+\z"  # no blank of any alphabet, no line break at the end
# Rationale when a score passes and when it does not; all but the first pair are fixed values.
RATIONALE = {
    "schema_validity": (
        "Candidate Proposal satisfies the output contract.",
        "Candidate Proposal does not satisfy the output contract.",
    ),
    "citation_quality": (
        "Candidate evidence refers only to failed checks with matching contract identities.",
        "Candidate evidence is incomplete, invented, or has a mismatched contract identity.",
    ),
    "groundedness": (
        "Every candidate action is attached to report-scoped quality evidence.",
        "Candidate actions are not grounded in this quality report.",
    ),
    "destructive_risk": (
        "No candidate action identifier has destructive SQL semantics.",
        "Candidate requested an action with destructive SQL semantics.",
    ),
    "allowlist_compliance": (
        "Every candidate action is catalogued.",
        "Candidate requested an action outside the remediation catalog.",
    ),
    "check_policy": (
        "Every candidate action is declared by the Check Policy and every failed check is covered.",
        "Candidate omitted failed-check coverage required by Check Policy.",
    ),
    "suite_completeness": (
        "",
        "The quality suite is incomplete; do not compile or admit a remediation.",
    ),
}
ILLEGAL = "Candidate requested an action that the Check Policy does not declare."
INVALID = "Invalid candidate."


def proposal_facts(justified: DataFrame) -> DataFrame:
    """What scoring needs to know of each proposal's actions, one row per proposal.

    Evidence is reduced to one row per (proposal, cited check) before the proposal is reduced,
    so a proposal of any size stays a partial aggregate.
    """
    entry = F.col("e")
    hit = F.try_element_at(F.col("failed"), entry["check_id"])
    cited = justified.select(
        "proposal_id", "action_id", "refusal", "evidence", "failed",
        F.explode_outer("evidence").alias("e"),
    ).select(
        "proposal_id",
        entry["check_id"].alias("check_id"),
        hit.isNotNull().alias("in_failed"),
        (hit.isNotNull() & ~hit["contract_id"].eqNullSafe(entry["contract_id"])).alias("mismatched"),
        F.col("refusal").isNull().alias("justified"),
        (F.coalesce(F.size("evidence"), F.lit(0)) == 0).alias("bare"),
        (~F.col("action_id").rlike(SLUG)).alias("bad_slug"),
        F.upper("action_id").rlike(DESTRUCTIVE).alias("destructive"),
        (~F.col("action_id").isin(*ACTIONS)).alias("unregistered"),
    )
    flags = ("mismatched", "bare", "bad_slug", "destructive", "unregistered")
    per_check = cited.groupBy("proposal_id", "check_id").agg(
        F.bool_or("in_failed").alias("in_failed"),
        F.bool_or("justified").alias("covers"),
        F.bool_and("justified").alias("legal"),
        *[F.bool_or(name).alias(name) for name in flags],
    )
    return per_check.groupBy("proposal_id").agg(
        F.count_if(F.col("in_failed")).alias("n_cited"),
        F.count_if(F.col("in_failed") & F.col("covers")).alias("n_covered"),
        F.count_if(F.col("check_id").isNotNull() & ~F.col("in_failed")).alias("n_unknown"),
        F.bool_and("legal").alias("legal"),
        *[F.bool_or(name).alias(name) for name in flags],
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def score_proposals(
    proposals: DataFrame,
    actions: DataFrame,
    results: DataFrame,
    registry: Registry,
    spark: SparkSession,
    thresholds: dict[str, float] | None = None,
    hot_rows: int = HOT_ROWS,
    justified: DataFrame | None = None,
) -> DataFrame:
    """(proposal_id, run_id, position, name, score, threshold, passed, rationale).

    ``proposals`` is (proposal_id, run_id[, valid]); ``valid`` is the outcome of parsing and
    defaults to true. ``suite_completeness`` is reported only for incomplete runs.
    """
    limits = {**THRESHOLDS, **(thresholds or {})}
    if justified is None:
        justified = justify(actions, results, registry, spark, hot_rows)
    facts = proposal_facts(justified)
    valid = F.coalesce("valid", F.lit(False)) if "valid" in proposals.columns else F.lit(True)
    runs = roll_up(results).select("run_id", F.col("failed").alias("n_failures"), "incomplete")
    known = skew_join(
        proposals.select("proposal_id", "run_id", valid.alias("valid")).join(
            facts.withColumn("has_actions", F.lit(True)), "proposal_id", "left"
        ),
        runs, ["run_id"], "left", hot_rows=hot_rows,
    ).select(
        "proposal_id", "run_id", "valid",
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
        # a run without results has no checks and is therefore incomplete
        F.coalesce("incomplete", F.lit(True)).alias("incomplete"),
        _flag("has_actions").alias("has_actions"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_cited", "n_covered", "n_unknown")],
        F.coalesce("legal", F.lit(True)).alias("legal"),
        *[_flag(n).alias(n) for n in ("mismatched", "bare", "bad_slug", "destructive", "unregistered")],
    )
    one = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    green = F.col("n_failures") == 0
    citation = (
        F.when(green, one(~F.col("has_actions")))
        .when((F.col("n_unknown") > 0) | F.col("mismatched"), 0.0)
        .otherwise(F.try_divide(F.col("n_cited").cast("double"), F.col("n_failures").cast("double")))
    )
    values = {
        "schema_validity": one(F.col("valid")),
        "citation_quality": citation,
        "groundedness": one(~(green & F.col("has_actions")) & ~F.col("bare") & ~F.col("bad_slug")),
        "destructive_risk": one(~F.col("destructive")),
        "allowlist_compliance": one(~F.col("unregistered")),
        "check_policy": one(F.col("legal") & (F.col("n_covered") == F.col("n_failures"))),
        "suite_completeness": F.when(F.col("incomplete"), 0.0),
    }
    entries = []
    for position, (name, value) in enumerate(values.items()):
        if name not in ("schema_validity", "suite_completeness"):
            value = F.when(F.col("valid"), value).otherwise(0.0)
        entries.append(F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("name"),
            value.alias("score"), F.lit(limits[name]).alias("threshold"),
        ))
    long = known.select(
        "proposal_id", "run_id", "valid", "legal", F.explode(F.array(*entries)).alias("s")
    ).select("proposal_id", "run_id", "valid", "legal", "s.*").filter(F.col("score").isNotNull())
    passed = F.col("score") >= F.col("threshold")
    return long.select(
        "proposal_id", "run_id", "position", "name", "score", "threshold",
        passed.alias("passed"), _rationale(passed).alias("rationale"),
    )


def _rationale(passed: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, (good, bad) in RATIONALE.items():
        text = F.when(F.col("name") == name, F.when(passed, good).otherwise(bad)).otherwise(text)
    illegal = (F.col("name") == "check_policy") & ~passed & ~F.col("legal")
    own = F.col("name").isin("schema_validity", "suite_completeness")
    return F.when(~F.col("valid") & ~own, INVALID).when(illegal, ILLEGAL).otherwise(text)


def score_details(justified: DataFrame) -> DataFrame:
    """(proposal_id, name, detail, id): which ids a score objects to, each once.

    Ids are what a proposal names, so their number has no bound; they are rows, not arrays. A
    proposal without actions has no row here; what it omits is in ``compiler.omitted_items``.
    """
    entry, hit = F.col("e"), F.try_element_at(F.col("failed"), F.col("e")["check_id"])
    cited = justified.select("proposal_id", "failed", "refusal", F.explode("evidence").alias("e")).select(
        "proposal_id", entry["check_id"].alias("check_id"), hit.isNull().alias("unknown"),
        (hit.isNotNull() & ~hit["contract_id"].eqNullSafe(entry["contract_id"])).alias("mismatched"))
    named = lambda rows, name, detail, column: rows.select(
        "proposal_id", F.lit(name).alias("name"), F.lit(detail).alias("detail"), F.col(column).alias("id"))
    asked = justified.select("proposal_id", "action_id", "refusal").distinct()
    covers = F.col("refusal").isNull() & F.exists("evidence", lambda e: e["check_id"] == F.col("due"))
    owed = justified.select("proposal_id", "refusal", "evidence", F.explode(F.map_keys("failed")).alias("due"))
    omitted = owed.groupBy("proposal_id", "due").agg(F.bool_or(covers).alias("covered")).filter("NOT covered")
    parts = (
        named(cited.filter("unknown"), "citation_quality", "unknown", "check_id"),
        named(cited.filter("mismatched"), "citation_quality", "mismatched_contracts", "check_id"),
        named(asked.filter(F.upper("action_id").rlike(DESTRUCTIVE)), "destructive_risk", "action_ids", "action_id"),
        named(asked.filter(~F.col("action_id").isin(*ACTIONS)), "allowlist_compliance", "action_ids", "action_id"),
        named(asked.filter("refusal IS NOT NULL"), "check_policy", "action_ids", "action_id"),
        named(omitted, "check_policy", "omitted", "due"),
    )
    return reduce(DataFrame.unionByName, parts).distinct()


def gate(scores: DataFrame) -> DataFrame:
    """Per proposal: passed, and every blocked reason in score order (at most one per score)."""
    blocked = F.when(~F.col("passed"), F.struct(
        "position", F.concat("name", F.lit(": "), "rationale").alias("text")))
    return scores.groupBy("proposal_id", "run_id").agg(
        F.bool_and("passed").alias("passed"),
        F.array_sort(F.collect_list(blocked)).alias("__blocked"),
    ).select(
        "proposal_id", "run_id", "passed",
        F.transform("__blocked", lambda item: item["text"]).alias("blocked_reasons"),
        F.when(F.col("passed"), "PASS — compile this candidate.")
        .otherwise("BLOCKED — do not compile this candidate.").alias("verdict"),
    )
