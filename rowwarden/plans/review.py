"""What a person sees before deciding, and the rules their decision must obey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowwarden.contracts import ACTIONS
from rowwarden.functions.fingerprint import struct_digest
from rowwarden.operators.joins import by_id
from rowwarden.registry import Registry

# Decision outcomes, the actor of a timeout, the default admission lifetime.
OUTCOMES = ("Approve", "Reject", "Timeout")
TIMEOUT_ACTOR = "airflow-timeout"
TTL_HOURS = 24
# Refusals of a recorded decision, first one reported.
BAD_OUTCOME = "unknown outcome kind"
BAD_TIMEOUT = "timeout requires no identity"
BAD_ACTOR = "actor is not allow-listed"
NO_NOTE = "approval requires a non-empty note"
# Conflicts between executable items, in the order they are looked for.
CONFLICTS = (
    "duplicate executable items in the remediation plan",
    "overlapping executable items share quality evidence",
    "conflicting mutating actions on the same table",
)


# Fixed value: what a review says about the end of an admission.
EXPIRY_TEXT = (
    "Apply Admission expires {} hours after the Human Decision. If it expires or Remediation Target Sets drift, "
    "recompile the Remediation Plan and request a new Human Decision; do not apply.")


def expiry_guidance(ttl_hours: float) -> str:
    return EXPIRY_TEXT.format(format(ttl_hours, "g"))


def review_items(items: DataFrame, registry: Registry, spark: SparkSession) -> DataFrame:
    """Executable items as shown: action, table, cited checks, target count, what it does."""
    rules = registry.actions_frame(spark).select("action_id", "mutates", "reversible")
    return items.filter(F.col("kind") == "executable").join(F.broadcast(rules), "action_id").select(
        "plan_id", "run_id", "ordinal", "action_id", "table",
        F.transform("evidence", lambda e: e["check_id"]).alias("evidence_check_ids"),
        "target_count", "target_fingerprint", "mutates", "reversible")


def approval_reviews(
    plans: DataFrame, evaluations: DataFrame, shown: DataFrame, ttl_hours: float = TTL_HOURS
) -> DataFrame:
    """One sample-free review per plan with its fingerprint and text.

    Repeated requests are blocked before this point, so the items of one plan are distinct
    (action, evidence) pairs: their number follows the registry, not the data.
    """
    if ttl_hours <= 0:
        raise ValueError("ttl_hours must be positive")
    fields = ("action_id", "table", "evidence_check_ids", "target_count", "target_fingerprint",
              "mutates", "reversible")
    grouped = shown.groupBy("plan_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("item")))),
        lambda x: x["item"]).alias("items"))
    judged = evaluations.select("plan_id", "evaluation_id", "evaluation_fingerprint",
                                F.col("passed").alias("evaluation_passed"), "scores")
    headed = by_id(plans.select("plan_id", "plan_fingerprint", "policy_fingerprint", "run_id"), judged, "plan_id")
    review = (
        by_id(headed, grouped, "plan_id", "left")
        .withColumn("items", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)))
        .withColumn("ttl_hours", F.lit(float(ttl_hours)))
    )
    review = review.withColumn("review_fingerprint", struct_digest(*[F.col(n) for n in (
        "plan_id", "plan_fingerprint", "policy_fingerprint", "run_id", "items", "evaluation_id",
        "evaluation_fingerprint", "evaluation_passed", "scores", "ttl_hours")]))
    return review.withColumn("body", review_text(ttl_hours))


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def review_text(ttl_hours: float) -> Column:
    label = lambda text, column: F.concat(F.lit(text), column.cast("string"))
    word = lambda ok: F.when(ok, "passed").otherwise("failed")
    scores = F.transform("scores", lambda s: F.concat(
        F.lit("- "), s["name"], F.lit(": "), s["score"].cast("string"), F.lit(" ("),
        word(s["passed"]), F.lit(") — "), s["rationale"]))
    items = F.transform("items", lambda i: F.concat(
        F.lit("- "), i["action_id"], F.lit(" on "), i["table"], F.lit("; mutates="), _yes(i["mutates"]),
        F.lit("; reversible="), _yes(i["reversible"]), F.lit("\n  Quality Evidence: "),
        F.array_join(i["evidence_check_ids"], ", "), F.lit("\n  Remediation Target Set count="),
        i["target_count"].cast("string"), F.lit(" fingerprint="), i["target_fingerprint"]))
    return F.concat_ws(
        "\n",
        label("Remediation Plan ", F.col("plan_id")),
        label("Plan fingerprint: ", F.col("plan_fingerprint")),
        label("Check Policy fingerprint: ", F.col("policy_fingerprint")),
        label("Quality run: ", F.col("run_id")),
        label("Review fingerprint: ", F.col("review_fingerprint")),
        F.lit(""),
        label("Evaluation: ", word(F.col("evaluation_passed"))),
        label("Evaluation id: ", F.col("evaluation_id")),
        label("Evaluation fingerprint: ", F.col("evaluation_fingerprint")),
        F.array_join(scores, "\n"),
        F.lit(""), F.lit("Executable items:"),
        F.when(F.size("items") == 0, "- none").otherwise(F.array_join(items, "\n")),
        F.lit(""),
        F.lit(f"Apply Admission TTL: {ttl_hours:g} hours after the Human Decision."),
        F.lit(expiry_guidance(ttl_hours)),
        F.lit(""),
        F.lit("Approve the whole plan or reject it. A note is required."),
    )


# What each governed action does, as a shadow review says it.
EFFECTS = {
    "no_op_alert": "Record the failure. Do not mutate.",
    "quarantine_nulls": "Copy rows where {column} IS NULL into dq.quarantine_rows; leave source intact until HITL.",
    "quarantine_invalids": (
        "Copy rows failing the controlled validity predicate into dq.quarantine_rows; leave source intact until HITL."),
    "null_fill": "UPDATE {table} SET {column} = :fill_value WHERE {column} IS NULL.",
    "quarantine_orphans": "Copy rows whose FK does not resolve into dq.quarantine_rows.",
    "dedupe_keep_min_pk": "Copy duplicate business-key rows (keep min pk) into quarantine. Source is not deleted in v1.",
    "schema_drift_ticket": "Do not auto-migrate. Open a contract change; humans update TABLE_CONTRACTS.",
}
# The labels of an entry, how a blocked and an empty plan fill them, and the last lines.
ENTRY = ("Table: ", "Failed checks: ", "Proposed effect: ", "Exact target count: ", "Risk: ", "Reversibility: ")
BLOCKED_ENTRY = ("unavailable (blocked)",) * 4
NO_ENTRY = ("none", "none", "none", "0", "none", "not applicable")
NEXT_RECORDED = (
    "Next: the Shadow Review was recorded. No Human Decision or Apply Admission was created. Quarantine copies rows into "
    "dq.quarantine_rows and does not repair source data.")
NEXT_NOTHING = "Next: no remediation is required. No Human Decision or Apply Admission was created."
NEXT_BLOCKED = "Next: do not request a Human Decision."


def shadow_reviews(reviews: DataFrame, plans: DataFrame, items: DataFrame, registry: Registry) -> DataFrame:
    """(plan_id, body): what a plan would do and what it may not, for a reader who decides nothing.

    ``reviews`` is the result of ``approval_reviews``. Tables are named by contract. Declared names
    are literals of the plan, so only a plan's own items are grouped.
    """
    named = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    contracts = named([(table, contract.contract_id) for table, contract in registry.contracts.items()])
    homes = named([(c.check_id, registry.contract(c.table).contract_id) for c in registry.checks.values()])
    effects, ranks = named(EFFECTS.items()), named([(name, rule.rank) for name, rule in ACTIONS.items()])
    entry = lambda *values: F.concat_ws("\n", *[F.concat(F.lit(a), b) for a, b in zip(ENTRY, values, strict=True)])
    words = lambda values: [F.lit(value) for value in values]

    cited = F.transform("evidence", lambda e: e["check_id"])
    tables = F.array_sort(F.array_distinct(F.transform(cited, lambda c: F.try_element_at(homes, c))))
    blocked = items.filter(F.col("kind") == "non_executable").select("plan_id", "ordinal", "item_id", entry(
        F.array_join(tables, ", "), F.array_join(cited, ", "), *words(BLOCKED_ENTRY)).alias("text"))
    refused = blocked.groupBy("plan_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "item_id", "text"))), lambda x: x["text"]).alias("refused"))
    allowed = F.transform("items", lambda i: entry(
        F.try_element_at(contracts, i["table"]), F.array_join(i["evidence_check_ids"], ", "),
        F.try_element_at(effects, i["action_id"]), i["target_count"].cast("string"),
        F.try_element_at(ranks, i["action_id"]), F.when(i["reversible"], "reversible").otherwise("not reversible")))
    shown = F.concat(allowed, F.coalesce("refused", F.array().cast("array<string>")))
    label = lambda text, column: F.concat(F.lit(text), F.col(column).cast("string"))
    passed = F.col("evaluation_passed")
    body = F.concat_ws(
        "\n", F.lit("Shadow Review"),
        F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise(entry(*words(NO_ENTRY))),
        F.when(F.size("blocked_reasons") > 0, F.concat(F.lit("Blocked: "), F.array_join("blocked_reasons", "; "))),
        F.concat(F.lit("Expiry guidance: "), F.format_string(EXPIRY_TEXT.replace("{}", "%s"), F.regexp_replace(
            F.col("ttl_hours").cast("string"), r"\.0$", ""))),
        F.when(passed & (F.size("items") > 0), NEXT_RECORDED).when(passed, NEXT_NOTHING).otherwise(NEXT_BLOCKED),
        F.lit("Audit details:"), label("Plan id: ", "plan_id"), label("Plan fingerprint: ", "plan_fingerprint"),
        label("Review fingerprint: ", "review_fingerprint"), label("Quality run: ", "run_id"),
        label("Evaluation id: ", "evaluation_id"), label("Evaluation fingerprint: ", "evaluation_fingerprint"))
    return by_id(by_id(reviews, plans.select("plan_id", "blocked_reasons"), "plan_id"), refused, "plan_id", "left").select(
        "plan_id", "run_id", body.alias("body"))


def plan_conflicts(items: DataFrame) -> DataFrame:
    """(plan_id, ordinal, conflict): the first conflict of every plan in item order.

    An item conflicts when an earlier executable item has the same request, cites one of its
    checks, or also mutates its table. Windows run over the executable items of one plan and
    key, whose number follows the registry.
    """
    executable = items.filter(F.col("kind") == "executable").select(
        "plan_id", "ordinal", "action_id", "table",
        F.transform("evidence", lambda e: e["check_id"]).alias("checks"))
    cited = executable.select("plan_id", "ordinal", F.explode("checks").alias("key"))
    mutating = [name for name, rule in ACTIONS.items() if rule.mutates]
    sources = (
        executable.select("plan_id", "ordinal", F.concat_ws(
            "|", "action_id", "table", F.array_join(F.array_sort("checks"), ",")).alias("key")),
        cited,
        executable.filter(F.col("action_id").isin(*mutating)).select(
            "plan_id", "ordinal", F.col("table").alias("key")),
    )
    seen = None
    for rank, source in enumerate(sources):
        order = Window.partitionBy("plan_id", "key").orderBy("ordinal")
        later = source.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 2).select(
            "plan_id", F.struct(F.col("ordinal"), F.lit(rank).alias("rank"),
                                F.lit(CONFLICTS[rank]).alias("conflict")).alias("c"))
        seen = later if seen is None else seen.unionByName(later)
    return seen.groupBy("plan_id").agg(F.min("c").alias("c")).select(
        "plan_id", "c.ordinal", "c.conflict")


# -- decisions -----------------------------------------------------------------------------


def parse_responses(responses: DataFrame, approvers: Sequence[str]) -> DataFrame:
    """Raw approval responses as decisions, or why they are refused.

    ``responses``: (timed_out, chosen_options array, user_id, approval_note, responded_at text).
    An unreadable response time falls back to ``received_at``, the time the response was stored,
    which unlike the current time is the same on every recomputation.
    """
    chosen = F.col("chosen_options")
    timed_out = F.coalesce("timed_out", F.lit(False))
    note = F.trim("approval_note")
    approves = F.array_contains(chosen, "Approve")
    problem = F.when(~timed_out, (
        F.when(chosen.isNull() | F.exists(chosen, lambda o: o.isNull()), "chosen_options is required")
        .when(~F.coalesce(F.col("user_id").isin(*approvers), F.lit(False)),
              "responder is not an allow-listed user")
        .when(approves & (F.coalesce(note, F.lit("")) == ""), "approval requires a non-empty approval_note")
    ))
    when = F.coalesce(
        F.expr("try_to_timestamp(regexp_replace(responded_at, 'Z$', '+00:00'))"), F.col("received_at"))
    return responses.withColumn("problem", problem).withColumn("decision", F.when(
        problem.isNull(), F.when(timed_out, "Timeout").when(approves, "Approve").otherwise("Reject"))
    ).withColumn("actor", F.when(problem.isNull(), F.when(timed_out, TIMEOUT_ACTOR).otherwise(F.col("user_id")))
    ).withColumn("note", F.when(problem.isNull() & ~timed_out, note)).withColumn("decided_at", when)


def decision_refusal(approvers: Sequence[str]) -> Column:
    """Why a decision may not be recorded, null when it may. Approvers are configuration."""
    timeout = F.col("decision") == "Timeout"
    return (
        F.when(~F.coalesce(F.col("decision").isin(*OUTCOMES), F.lit(False)), BAD_OUTCOME)
        .when(timeout & ~F.col("actor").eqNullSafe(F.lit(TIMEOUT_ACTOR)), BAD_TIMEOUT)
        .when(~timeout & ~F.coalesce(F.col("actor").isin(*approvers), F.lit(False)), BAD_ACTOR)
        .when((F.col("decision") == "Approve") & (F.coalesce(F.trim("note"), F.lit("")) == ""), NO_NOTE)
    )


def instant(name: str) -> Column:
    """A time for a digest: microseconds since the epoch, the same in every session zone."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def decision_fingerprint() -> Column:
    return struct_digest(
        F.col("decision_id"), F.col("decision"), F.col("actor"), F.col("note"),
        instant("decided_at").alias("decided_at"))


def record_decisions(decisions: DataFrame, approvers: Sequence[str]) -> DataFrame:
    """Decisions with ``refusal`` and, when accepted, their fingerprint."""
    refusal = decision_refusal(approvers)
    return decisions.withColumn("refusal", refusal).withColumn(
        "decision_fingerprint", F.when(refusal.isNull(), decision_fingerprint()))
