"""Compile candidate actions into controlled plans, for any number of proposals at once.

A plan item is executable only when its request is justified, not repeated, on one table and
has an exact target set; everything else becomes an explicit blocked item, and failures nobody
asked about become one ``omitted-failures`` item, so a plan is complete even when it is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.functions.fingerprint import (
    empty_set_digest,
    row_hash,
    set_digest,
    struct_digest,
    text_digest,
)
from rowwarden.operators.joins import HOT_ROWS, by_id, key_groups, skew_join
from rowwarden.operators.proposals import blocked_reason, justify, run_failures
from rowwarden.operators.suite import roll_up
from rowwarden.registry import Registry
from rowwarden.session import config_frame, packed, spread, stored

# Bounded reasons of blocked items beyond those of a refused request.
INCOMPLETE = "quality suite is incomplete"
DUPLICATE = "duplicate candidate action and quality evidence"
UNAVAILABLE = "candidate action is unavailable under the controlled policy"
NO_TARGET = "remediation target set could not be resolved"
OMITTED = "candidate proposal omitted failed-check coverage"
# Plan scores and their rationale when passed and when not.
PLAN_SCORES = {
    "plan_compilation": (
        "Every failed check is covered by an executable controlled plan item.",
        "The remediation plan contains explicit blocked or omitted outcomes.",
    ),
    "policy_snapshot": (
        "The compiled plan still matches the current check policy and renderer.",
        "Check policy, table contract, remediation rule, or renderer drifted after compilation.",
    ),
    "target_set_integrity": (
        "Every executable item has an exact target-set count and fingerprint.",
        "An executable plan item has no valid target-set summary.",
    ),
}
ITEM_FIELDS = (
    "item_id", "kind", "action_id", "table", "params", "evidence", "reason", "target_count",
    "target_fingerprint", "policy_fingerprint",
)


def short_id(*parts: Column) -> Column:
    """A stable id: recomputing a lost partition gives the same one, unlike a random id."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


def identity(evidence: Column) -> Column:
    """Evidence in canonical order, as text."""
    return F.coalesce(F.to_json(F.array_sort(evidence)), F.lit("[]"))


def repeated(actions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Actions with ``duplicate``: the same request occurs more than once in its proposal.
    Every copy is marked. Requests are counted before they are joined back."""
    keyed = actions.withColumn("__evidence", identity(F.col("evidence")))
    keys = ["proposal_id", "action_id", "__evidence"]
    counts = stored(key_groups(keyed, keys).filter(F.col("n") > 1), "repeats")
    marked = skew_join(
        keyed, counts.select(*keys, F.lit(True).alias("__twice")), keys, "left",
        sizes=counts, hot_rows=hot_rows,
    )
    return marked.select(
        *actions.columns, F.coalesce("__twice", F.lit(False)).alias("duplicate")
    )


def policy_lookup(registry: Registry, evidence: Column, action_id: Column) -> Column:
    """The policy fingerprint of an item under ``registry``: of its checks, in cited order.

    The literal map has one entry per declared policy. A check or policy that is gone shows as
    ``gone``, so drift is a difference rather than an error.
    """
    pairs = []
    for spec in registry.checks.values():
        for policy in spec.policies:
            pairs += [F.lit(f"{spec.check_id}|{policy.action_id}"),
                      F.lit(registry.policy_fingerprint(spec.check_id, policy.action_id))]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    each = F.transform(evidence, lambda item: F.coalesce(
        F.try_element_at(known, F.concat(item["check_id"], F.lit("|"), action_id)), F.lit("gone")))
    return text_digest(F.concat_ws(",", each))


def compile_items(
    proposals: DataFrame,
    actions: DataFrame,
    results: DataFrame,
    targets: DataFrame,
    registry: Registry,
    spark: SparkSession,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All plan items: (plan_id, run_id, proposal_id, ordinal, *ITEM_FIELDS).

    ``targets`` comes from ``target_sets`` and has one row per declared policy.
    """
    runs = roll_up(results).select("run_id", "incomplete")
    # stored, so that the join below counts the runs' rows without judging them a second time
    judged = packed(spread(justify(repeated(actions, hot_rows), results, registry, spark, hot_rows).drop("failed"), "proposal_id"), "judged")
    judged = skew_join(judged, runs, ["run_id"], "left", hot_rows=hot_rows)
    sets = targets.select(
        F.col("check_id").alias("__check"), F.col("action_id").alias("__action"),
        F.col("table").alias("__table"), "target_count", "target_fingerprint",
    )
    first = F.try_element_at(F.col("evidence"), F.lit(1))["check_id"]
    judged = judged.withColumn("__first", first).join(
        F.broadcast(sets),
        (F.col("__first") == F.col("__check")) & (F.col("action_id") == F.col("__action")), "left",
    )
    incomplete = F.coalesce("incomplete", F.lit(True))
    reason = (
        F.when(incomplete, INCOMPLETE)
        .when(F.col("duplicate"), DUPLICATE)
        .when(F.col("refusal").isNotNull(), blocked_reason(F.col("refusal")))
        .when(F.size("home_tables") > 1, UNAVAILABLE)
        .when(F.col("target_count").isNull(), NO_TARGET)
    )
    has_evidence = F.coalesce(F.size("evidence"), F.lit(0)) > 0
    executable = F.col("__reason").isNull()
    kept = lambda column: F.when(executable, column)
    requested = judged.filter(~incomplete | has_evidence).withColumn("__reason", reason).select(
        "run_id", "proposal_id", F.col("ordinal").cast("bigint").alias("ordinal"),
        F.concat(F.lit("candidate-"), F.col("ordinal").cast("string")).alias("item_id"),
        F.when(executable, "executable").otherwise("non_executable").alias("kind"),
        kept(F.col("action_id")).alias("action_id"), kept(F.col("__table")).alias("table"),
        kept(F.col("params")).alias("params"), "evidence", F.col("__reason").alias("reason"),
        kept(F.col("target_count")).alias("target_count"),
        kept(F.col("target_fingerprint")).alias("target_fingerprint"),
        kept(policy_lookup(registry, F.col("evidence"), F.col("action_id"))).alias("policy_fingerprint"),
    )
    missed = omitted_items(proposals, actions, results, registry, spark, hot_rows)
    return requested.unionByName(missed, allowMissingColumns=True).select(
        short_id(F.col("run_id").cast("string"), F.col("proposal_id").cast("string")).alias("plan_id"),
        "run_id", "proposal_id", "ordinal", *ITEM_FIELDS,
    )


def omitted_items(
    proposals: DataFrame, actions: DataFrame, results: DataFrame, registry: Registry,
    spark: SparkSession, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One blocked item per proposal of a complete run that leaves failed checks uncited.

    A failed check is covered as soon as any request cites it, executable or not.
    """
    failures = run_failures(results, registry)
    complete = roll_up(results).filter(~F.col("incomplete")).select("run_id")
    open_runs = failures.join(complete, "run_id", "left_semi").select(
        "run_id", F.transform(F.map_entries("failed"), lambda e: F.struct(
            e["key"].alias("check_id"), e["value"]["contract_id"].alias("contract_id"))).alias("__due"))
    cited = (
        actions.select("proposal_id", F.explode("evidence").alias("e"))
        .select("proposal_id", F.col("e")["check_id"].alias("check_id")).distinct()
        # only declared checks can be due, which bounds the set collected per proposal and the broadcast
        .join(F.broadcast(config_frame(results.sparkSession, [(name,) for name in registry.checks], "check_id string")),
              "check_id", "left_semi")
        .groupBy("proposal_id").agg(F.collect_set("check_id").alias("__cited"))
    )
    due = by_id(skew_join(proposals.select("proposal_id", "run_id"), open_runs, ["run_id"], "inner",
                          hot_rows=hot_rows), cited, "proposal_id", "left")
    left = F.array_sort(F.filter("__due", lambda e: ~F.coalesce(
        F.array_contains(F.col("__cited"), e["check_id"]), F.lit(False))))
    return due.withColumn("evidence", left).filter(F.size("evidence") > 0).select(
        "run_id", "proposal_id", F.lit(None).cast("bigint").alias("ordinal"),
        F.lit("omitted-failures").alias("item_id"), F.lit("non_executable").alias("kind"),
        "evidence", F.lit(OMITTED).alias("reason"),
    )


def item_hash() -> Column:
    return row_hash(F.to_json(F.struct(*ITEM_FIELDS), {"ignoreNullFields": "false"}))


def plan_fingerprint(prefix: str = "") -> Column:
    """The plan's own digest, from its header fields; items enter through their set digest."""
    return struct_digest(*[F.col(prefix + name) for name in (
        "plan_id", "run_id", "candidate_fingerprint", "policy_fingerprint", "environment_id",
        "items_fingerprint")])


def item_digests(items: DataFrame) -> DataFrame:
    """Per plan: item counts, target total and digests of its items."""
    executable = F.col("kind") == "executable"
    hashed = items.select(
        "plan_id", "kind", "reason", "target_count", item_hash().alias("__item"),
        F.when(executable, row_hash(F.concat_ws("|", "item_id", "policy_fingerprint"))).alias("__policy"),
        F.when(executable, row_hash(F.concat_ws("|", "item_id", "target_fingerprint"))).alias("__target"),
    )
    return hashed.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(executable).alias("n_executable"),
        F.coalesce(F.sum("target_count"), F.lit(0)).alias("target_count"),
        set_digest("__item", "items").alias("items_fingerprint"),
        set_digest("__policy", "policy").alias("policy_fingerprint"),
        set_digest("__target", "targets").alias("target_set_fingerprint"),
    )


def item_totals(items: DataFrame) -> DataFrame:
    """``item_digests`` with the distinct blocked reasons. Those are collected apart: beside a collected set the
    sums would be sorted instead of hashed."""
    reasons = items.filter(F.col("reason").isNotNull()).groupBy("plan_id").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"))  # a fixed vocabulary
    return by_id(item_digests(items), reasons, "plan_id", "left").withColumn(
        "reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def candidate_fingerprints(actions: DataFrame) -> DataFrame:
    """Digest of each proposal's requests, ordinals included, so order matters."""
    hashed = actions.select("proposal_id", row_hash(F.to_json(
        F.struct("ordinal", "action_id", "evidence"), {"ignoreNullFields": "false"})).alias("__h"))
    return hashed.groupBy("proposal_id").agg(
        set_digest("__h", "candidate").alias("candidate_fingerprint"))


def roll_up_plans(
    proposals: DataFrame, actions: DataFrame, results: DataFrame, items: DataFrame,
    environment_id: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per plan. It is blocked as soon as one item is, or when its suite is incomplete."""
    runs = roll_up(results).select("run_id", "incomplete")
    headed = skew_join(proposals.select("proposal_id", "run_id"), runs, ["run_id"], "left",
                       hot_rows=hot_rows)
    plan_id = short_id(F.col("run_id").cast("string"), F.col("proposal_id").cast("string"))
    joined = by_id(by_id(headed.withColumn("plan_id", plan_id), candidate_fingerprints(actions), "proposal_id", "left"),
                   item_totals(items), "plan_id", "left")
    incomplete = F.coalesce("incomplete", F.lit(True))
    found = F.coalesce("reasons", F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.when(
        incomplete, F.array_append(found, F.lit(INCOMPLETE))).otherwise(found)))
    zero = F.lit(0).cast("bigint")
    plans = joined.select(
        "plan_id", "run_id", "proposal_id", incomplete.alias("incomplete"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("n_executable", zero).alias("n_executable"),
        reasons.alias("blocked_reasons"), (F.size(reasons) > 0).alias("blocked"),
        F.coalesce("target_count", zero).alias("target_count"),
        *[F.coalesce(name, empty_set_digest(label)).alias(name) for name, label in (
            ("candidate_fingerprint", "candidate"), ("policy_fingerprint", "policy"),
            ("items_fingerprint", "items"), ("target_set_fingerprint", "targets"))],
        F.lit(environment_id).alias("environment_id"),
    )
    return plans.withColumn("plan_fingerprint", plan_fingerprint())


# -- plan evaluation -------------------------------------------------------------------------


def policy_drift(items: DataFrame, registry: Registry) -> DataFrame:
    """Executable items with ``drifted``: their policy differs under the current registry."""
    now = policy_lookup(registry, F.col("evidence"), F.col("action_id"))
    return items.filter(F.col("kind") == "executable").withColumn(
        "drifted", ~F.col("policy_fingerprint").eqNullSafe(now))


def evaluate_plans(plans: DataFrame, items: DataFrame, registry: Registry) -> DataFrame:
    """(plan_id, run_id, intact, position, name, score, passed, rationale).

    ``intact`` is false when the plan's fingerprint does not recompute from its items; such a
    plan has no valid evaluation.
    """
    drifted = policy_drift(items, registry).groupBy("plan_id").agg(
        F.bool_or("drifted").alias("drifted"),
        F.bool_or(F.coalesce(
            (F.col("target_count") < 0) | (F.coalesce("target_fingerprint", F.lit("")) == ""),
            F.lit(True))).alias("bad_target"),
    )
    again = item_digests(items).select(
        "plan_id", F.col("items_fingerprint").alias("__items"),
        F.col("policy_fingerprint").alias("__policy"))
    joined = by_id(by_id(plans, again, "plan_id", "left"), drifted, "plan_id", "left")
    recomputed = (
        (F.coalesce("__items", F.col("items_fingerprint")) == F.col("items_fingerprint"))
        & (F.coalesce("__policy", F.col("policy_fingerprint")) == F.col("policy_fingerprint"))
        & (plan_fingerprint() == F.col("plan_fingerprint"))
    )
    checks = {
        "plan_compilation": ~F.col("blocked") & (F.col("n_executable") == F.col("n_items")),
        "policy_snapshot": ~F.coalesce("drifted", F.lit(False)),
        "target_set_integrity": ~F.coalesce("bad_target", F.lit(False)),
    }
    entries = F.array(*[
        F.struct(F.lit(n).alias("position"), F.lit(name).alias("name"), ok.alias("passed"),
                 F.when(ok, PLAN_SCORES[name][0]).otherwise(PLAN_SCORES[name][1]).alias("rationale"))
        for n, (name, ok) in enumerate(checks.items())
    ])
    return joined.select("plan_id", "run_id", recomputed.alias("intact"), F.explode(entries).alias("s")).select(
        "plan_id", "run_id", "intact", "s.position", "s.name",
        F.when(F.col("s.passed"), 1.0).otherwise(0.0).alias("score"), "s.passed", "s.rationale")


def evaluations(plans: DataFrame, scores: DataFrame) -> DataFrame:
    """One evaluation per plan, fingerprinted over its three scores and bound to the plan."""
    entry = F.struct("position", "name", "score", "passed", "rationale")
    per_plan = scores.groupBy("plan_id").agg(
        F.bool_and("passed").alias("passed"), F.bool_and("intact").alias("intact"),
        F.array_sort(F.collect_list(entry)).alias("scores"))  # three entries
    joined = by_id(plans.select("plan_id", "run_id", "plan_fingerprint"), per_plan, "plan_id")
    return joined.withColumn("evaluation_id", short_id(F.lit("evaluation"), F.col("plan_id"))).withColumn(
        "evaluation_fingerprint", evaluation_fingerprint())


def evaluation_fingerprint() -> Column:
    return struct_digest(*[F.col(n) for n in (
        "evaluation_id", "plan_id", "plan_fingerprint", "passed", "scores")])
