"""Apply admitted plans: copy their exact target rows, then commit once.

Order of an apply: verify the stored artifacts, write the target rows of all plans with one job per
table and which items own them, compare what was written with the admitted target sets, and make the log entries of
those that agree visible by one manifest. Until then none of the copies is visible, and no two
attempts write the same files. Source tables are only read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden.contracts import ACTIONS
from rowwarden.functions.fingerprint import empty_set_digest, row_hash, set_digest, struct_digest
from rowwarden.operators.joins import by_id, fits_broadcast, skew_join
from rowwarden.operators.lineage import apply_events
from rowwarden.operators.remediation import (
    filled_rows,
    label_of,
    quarantine_copies,
    readable,
    recheck,
    target_sets,
)
from rowwarden.plans.admission import (
    admission_integrity,
    evaluation_integrity,
    param_problems,
    plan_integrity,
    report_integrity,
)
from rowwarden.plans.compiler import policy_drift
from rowwarden.registry import Registry
from rowwarden.session import config_frame, forget, packed, stored
from rowwarden.sources.sinks import COPY_TABLES, Store

FILLED = "filled_by_apply"  # marks the rows a fill changed
# Refusal and problem texts of this module.
FAILED_REASON = "controlled apply failed before a result could be admitted"
STEP_TYPE = "array<struct<action_id:string,table:string,estimated_rows:bigint,rowcount:bigint>>"


class ApplyRefused(PermissionError):
    """The plan may not be applied; nothing became visible."""


# -- relational parts, over any number of admissions --------------------------------------


def consumed(admissions: DataFrame, log: DataFrame) -> DataFrame:
    """Admissions that already have a committed result. A blank id is never consumed."""
    named = F.coalesce(F.trim("admission_id"), F.lit("")) != ""
    return admissions.filter(named).join(
        log.filter(named).select("admission_id").distinct(), "admission_id", "left_semi")


def expired(now: Column, expires_at: Column) -> Column:
    """Past its end, or with less than a millisecond left."""
    left_ms = F.floor((F.unix_micros(expires_at) - F.unix_micros(now)) / 1000)
    return (now > expires_at) | (left_ms <= 0)


def other_environment(applied: str | Column, plan_env: Column, admission_env: Column) -> Column:
    here = applied if isinstance(applied, Column) else F.lit(applied)
    return ~(here.eqNullSafe(plan_env) & here.eqNullSafe(admission_env))


def result_fingerprint() -> Column:
    return struct_digest(*[F.col(name) for name in (
        "quality_run_id", "plan_fingerprint", "admission_fingerprint", "run_id", "dry_run", "steps")])


def result_totals(items: DataFrame, rowcounts: DataFrame | None = None) -> DataFrame:
    """Per plan: targets, a digest of the items' target fingerprints in item order, and copied
    rows. Item ids are part of each hash, so swapping two items changes the digest."""
    executable = items.filter(F.col("kind") == "executable")
    if rowcounts is not None:
        executable = executable.join(rowcounts, ["plan_id", "item_id"], "left")
    else:
        executable = executable.withColumn("rowcount", F.col("target_count"))
    return executable.select(
        "plan_id", "target_count", "rowcount",
        row_hash(F.concat_ws("|", "item_id", "target_fingerprint")).alias("__h"),
    ).groupBy("plan_id").agg(
        F.sum("target_count").alias("target_count"),
        F.sum("rowcount").alias("rowcount"),
        set_digest("__h", "targets").alias("target_fingerprint"))


def recover(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Committed results for repeated requests, or why a result does not bind the request.

    ``requests``: admission_id, plan_id, quality_run_id, plan_fingerprint, admission_fingerprint
    and the executable ``steps`` of the plan as array<struct<action_id,table>> in item order.
    Reading only: recovery works after expiry and never authorises anything.
    """
    entry = log.select(
        "admission_id", F.col("plan_id").alias("l_plan"), "run_id", "apply_result_id",
        F.col("steps").alias("l_steps"), "event_id",
        F.col("result_fingerprint").alias("l_result"))
    named = F.coalesce(F.trim("admission_id"), F.lit("")) != ""
    joined = requests.filter(named).join(entry, "admission_id")
    shape = F.transform("l_steps", lambda s: F.struct(
        s["action_id"].alias("action_id"), s["table"].alias("table")))
    again = struct_digest(
        F.col("quality_run_id"), F.col("plan_fingerprint"), F.col("admission_fingerprint"),
        F.col("run_id"), F.lit(False).alias("dry_run"), F.col("l_steps").alias("steps"))
    problem = (
        F.when(~F.col("l_plan").eqNullSafe(F.col("plan_id")), "apply log plan_id does not match")
        .when(~shape.eqNullSafe(F.col("steps")), "apply step evidence does not match the supplied plan")
        .when(~F.col("l_result").eqNullSafe(again),
              "result fingerprint does not match the committed evidence")
        .when(F.coalesce("apply_result_id", F.lit("")) == "", "apply result id is missing")
        .when(F.coalesce("event_id", F.lit("")) == "", "audit event id is missing"))
    return joined.select(
        "admission_id", "plan_id", problem.alias("problem"), "run_id", "apply_result_id",
        "event_id", F.col("l_steps").alias("steps"), F.col("l_result").alias("result_fingerprint"))


# -- applying -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Artifacts:
    """The stored artifacts an apply is verified against; each may hold any number of plans."""

    plans: DataFrame
    items: DataFrame
    evaluations: DataFrame
    reports: DataFrame
    results: DataFrame


@dataclass
class ApplyResult:
    plan_id: str
    run_id: str
    dry_run: bool
    admission_id: str | None = None
    apply_result_id: str | None = None
    fingerprint: str | None = None
    event_id: str | None = None
    steps: list[dict] = field(default_factory=list)
    recovered: bool = False


CHANGED = "controlled target set changed after plan compilation"
EXPIRED = "apply admission has expired"
OUTCOME = (
    "plan_id string, admission_id string, outcome string, problem string, run_id string, apply_result_id string,"
    f" result_fingerprint string, event_id string, steps {STEP_TYPE}")


def _first(rules: list[tuple[Column, Column | str]]) -> Column:
    """The text of the first rule that is broken; an unknown one is not."""
    found = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        found = F.when(F.coalesce(broken, F.lit(False)), text).otherwise(found)
    return found


def _headers(art: Artifacts, wanted: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan_id, header fields, plan_problem) of the wanted plans, with their plan rows and evaluations. All
    artifacts are cut down to these plans first."""
    spark = wanted.sparkSession
    plans, items, judged = (by_id(frame, wanted, "plan_id", "left_semi") for frame in (art.plans, art.items, art.evaluations))
    runs = plans.select("run_id").distinct()
    results, reports = (frame.join(runs, "run_id", "left_semi") for frame in (art.results, art.reports))
    drift = policy_drift(items, registry).groupBy("plan_id").agg(F.bool_or("drifted").alias("drifted"))
    problems = param_problems(plans, items, results, registry, spark).withColumnRenamed("problem", "param_problem")
    evaluated = judged.select("plan_id", "evaluation_id", "evaluation_fingerprint", F.col("passed").alias("eval_passed"),
                              F.col("plan_fingerprint").alias("eval_plan_fp"))
    head = plans.select("plan_id", F.col("run_id").alias("quality_run_id"), "run_id", "plan_fingerprint", "policy_fingerprint",
                        "environment_id", "blocked")
    joined = by_id(wanted, skew_join(head, report_integrity(reports, results), ["run_id"], "left").drop("run_id"), "plan_id", "left")
    for facts in (evaluated, plan_integrity(plans, items), evaluation_integrity(judged), drift, problems):
        joined = by_id(joined, facts, "plan_id", "left")
    no = lambda flag: ~F.coalesce(F.col(flag), F.lit(False))
    # fixed values: the texts, in the order the rules are looked at
    problem = _first([
        (F.col("quality_run_id").isNull(), "remediation plan was not found"),
        (F.col("blocked"), "remediation plan is blocked"),
        (no("eval_passed"), "remediation-plan evaluation did not pass"),
        (no("report_intact"), "quality report fingerprint does not match received payload"),
        (no("plan_intact"), "remediation plan fingerprint does not match received payload"),
        (no("evaluation_intact"), "evaluation fingerprint does not match received payload"),
        (~F.col("eval_plan_fp").eqNullSafe(F.col("plan_fingerprint")), "evaluation does not belong to this remediation plan"),
        (F.col("drifted"), "policy snapshot drifted after evaluation"),
        (F.col("param_problem").isNotNull(), F.col("param_problem"))])
    return joined.select(
        "plan_id", "quality_run_id", "plan_fingerprint", "policy_fingerprint", "environment_id", "evaluation_id",
        "evaluation_fingerprint", problem.alias("plan_problem")), plans, judged


def _admitted(art: Artifacts, wanted: DataFrame) -> Artifacts:
    """Plans, items and evaluations of the wanted plans. Admitted plans are few among those compiled, and every later step
    would shuffle all of them to find its own; stored, each is shuffled whole once."""
    kept = {name: packed(by_id(getattr(art, name), wanted, "plan_id", "left_semi"), f"admitted_{name}")
            for name in ("plans", "items", "evaluations")}
    return replace(art, **kept)


def _executable(art: Artifacts, wanted: DataFrame) -> DataFrame:
    """Executable items of the wanted plans, with the columns of ``wanted``."""
    first = F.try_element_at("evidence", F.lit(1))["check_id"]
    return by_id(art.items.filter(F.col("kind") == "executable").select(
        "plan_id", "item_id", "ordinal", "action_id", "table", first.alias("check_id"), "target_count",
        "target_fingerprint"), wanted, "plan_id")


def _steps(rowcount: Column) -> Column:
    """The steps of a plan in item order; a plan has at most one item per declared request."""
    entry = F.struct("ordinal", "action_id", "table", F.col("target_count").alias("estimated_rows"), rowcount.cast("bigint").alias("rowcount"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(
        s["action_id"].alias("action_id"), s["table"].alias("table"), s["estimated_rows"].alias("estimated_rows"),
        s["rowcount"].alias("rowcount")))


def _evidence(rows: DataFrame, run_id: str, dry: bool, outcome: str, reasons: list[str], now: datetime) -> tuple[DataFrame, DataFrame]:
    """Results as rows, with their fingerprints, ids and event ids, and the audit events that tell of them. ``rows`` has
    the header fields, steps, and for an apply decision_id, decision_event_id and admission_fingerprint."""
    none = F.lit(None).cast("string")
    given = set(rows.columns)
    full = rows.select(
        "*", *[none.alias(n) for n in ("decision_id", "admission_fingerprint", "admission_id", "decision_event_id") if n not in given],
        F.lit(run_id).alias("run_id"), F.lit(dry).alias("dry_run"), F.lit(now).cast("timestamp").alias("applied_at"),
        F.lit(reasons).cast("array<string>").alias("reasons"))
    full = full.withColumn("previous_id", F.coalesce("decision_event_id", "evaluation_id"))
    full = full.withColumn("result_fingerprint", result_fingerprint())
    full = full.withColumn("apply_result_id", F.substring(
        F.sha2(F.concat_ws("|", "result_fingerprint", "run_id", F.lit(outcome)), 256), 1, 32))
    events = apply_events(full.withColumn("run_id", F.col("quality_run_id")), outcome)
    return by_id(full, events.select("plan_id", "apply_result_id", "event_id"), ["plan_id", "apply_result_id"]), events


def _staged(art_items: DataFrame, registry: Registry, frames: Mapping[str, DataFrame], store: Store, run_id: str,
            attempt: str, clock: Callable[[], datetime]) -> DataFrame:
    """Write the target rows of all policies, one job per table and one per fill, and who owns them, and sum up what was
    written: (admission_id, item_id, written, written_fingerprint). Rows that many items copy are written once."""
    policies = [tuple(row) for row in art_items.select("check_id", "action_id").distinct().collect()]  # declared policies
    by_table: dict[str, list[tuple[str, str]]] = {}
    for check_id, action_id in policies:
        if ACTIONS[action_id].mutates and readable(registry, frames, check_id, action_id):
            by_table.setdefault(registry.check(check_id).table, []).append((check_id, action_id))
    owners = art_items.select("check_id", "action_id", "admission_id", "item_id")
    named = "admission_id string, item_id string, written bigint, written_fingerprint string"
    parts = [config_frame(store.spark, [], named)]
    labels = []
    for table, mine in by_table.items():
        copies = [p for p in mine if p[1] != "null_fill"]
        if copies:
            found = quarantine_copies(registry, frames, table, copies, run_id)
            store.stage_sets(found.withColumn("set_id", set_id()), attempt, clock())
            labels += [(check_id, action_id, label_of(table, action_id)) for check_id, action_id in copies]
        for check_id, action_id in (p for p in mine if p[1] == "null_fill"):
            filled = filled_rows(registry, check_id, frames, mark=FILLED).select(
                "*", F.lit(check_id).alias("fill_check"), F.lit(action_id).alias("fill_action"))
            owner = owners.select(F.col("check_id").alias("fill_check"), F.col("action_id").alias("fill_action"), "admission_id", "item_id")
            staged = store.stage_filled(filled.join(F.broadcast(owner) if fits_broadcast(owner) else owner, ["fill_check", "fill_action"]).drop(
                "fill_check", "fill_action"), table, attempt)
            parts.append(staged.filter(FILLED).select(
                "admission_id", "item_id", F.lit(label_of(table, action_id)).alias("label"),
                row_hash(F.col(registry.contract(table).single_key)).alias("pk_hash")).groupBy(
                "admission_id", "item_id", "label").agg(*_written()).drop("label"))
    if labels:
        declared = F.broadcast(config_frame(store.spark, labels, "check_id string, action_id string, label string").withColumn("set_id", set_id()))
        bound = owners.join(declared, ["check_id", "action_id"]).select("set_id", "admission_id", "item_id")
        store.stage_owners(bound, attempt)
        # one row per declared policy
        sums = store.staged_sets(attempt).join(declared, "set_id").groupBy("set_id", "label").agg(*_written()).drop("label")
        parts.append(bound.join(F.broadcast(sums), "set_id").drop("set_id"))
    return reduce(DataFrame.unionByName, parts)


def _written() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("written"), set_digest("pk_hash", column="label").alias("written_fingerprint")


def set_id() -> Column:
    """The set of target rows that one declared policy copies."""
    return F.concat_ws("|", "check_id", "action_id")


def dry_run_plans(art: Artifacts, plan_ids: DataFrame, registry: Registry, frames: Mapping[str, DataFrame],
                  store: Store, run_id: str, now: datetime | None = None) -> DataFrame:
    """(``OUTCOME``) of each plan in ``plan_ids`` (plan_id): verified and rechecked, with the estimated rows
    as steps. Each table is read once for all plans. Nothing is written but one event per plan that passed."""
    wanted = plan_ids.select("plan_id").distinct()
    heads = stored(_headers(art, wanted, registry)[0], "dry_headers")
    items = stored(_executable(art, heads.filter("plan_problem is null").select("plan_id")), "dry_items")
    policies = [tuple(row) for row in items.select("check_id", "action_id").distinct().collect()]
    planned = items.select("plan_id", "check_id", "action_id", "target_count", "target_fingerprint")
    checked = recheck(planned, target_sets(registry, frames, store.spark, policies)).groupBy("plan_id").agg(
        F.bool_and("unchanged").alias("unchanged"))
    steps = items.groupBy("plan_id").agg(_steps(F.lit(None)).alias("steps"))
    judged = by_id(by_id(heads, checked, "plan_id", "left"), steps, "plan_id", "left").withColumn(
        "problem", F.coalesce("plan_problem", F.when(~F.coalesce("unchanged", F.lit(True)), CHANGED))).withColumn(
        "steps", F.coalesce("steps", F.array().cast(STEP_TYPE)))
    judged = stored(judged, "dry_judged")
    rows, events = _evidence(judged.filter("problem is null"), run_id, True, "dry_run", [], now or datetime.now(timezone.utc))
    store.append_events(events, now or datetime.now(timezone.utc))
    return _outcomes(rows.withColumn("outcome", F.lit("dry_run"))).unionByName(_outcomes(
        judged.filter("problem is not null").withColumn("outcome", F.lit("refused"))))


def _outcomes(rows: DataFrame) -> DataFrame:
    kinds = T.StructType.fromDDL(OUTCOME)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def apply_plans(
    art: Artifacts,
    admissions: DataFrame,
    registry: Registry,
    frames: Mapping[str, DataFrame],
    store: Store,
    run_id: str,
    environment_id: str,
    clock: Callable[[], datetime] | None = None,
) -> DataFrame:
    """(``OUTCOME``) of each admission: applied, recovered (committed by an earlier attempt) or refused with its problem.

    Every plan stands or falls as a whole, independently of the others. All copies of a table are staged by
    one job; what was written is compared with the admitted target sets; plans that agree are committed
    together by one manifest. Repeated admissions of one plan count once. ``clock`` is read before every step that
    could make a copy durable. A plan whose targets changed, or whose admission ran out before the commit,
    leaves an ``apply_failed`` event."""
    clock = clock or (lambda: datetime.now(timezone.utc))
    mine = admissions.dropDuplicates(["plan_id"])
    art = _admitted(art, mine.select("plan_id"))
    heads, plans, judged = _headers(art, mine.select("plan_id"), registry)
    granted = mine.select(
        "plan_id", "admission_id", "decision_id", "decision_event_id", "expires_at", F.col("fingerprint").alias("admission_fingerprint"),
        F.col("policy_fingerprint").alias("granted_policy"), F.col("environment_id").alias("granted_environment"))
    bound = admission_integrity(mine, plans, judged).withColumnRenamed("problem", "admission_problem")
    problem = F.coalesce("plan_problem", "admission_problem", _first([
        (~F.col("granted_policy").eqNullSafe(F.col("policy_fingerprint")), "policy snapshot drifted after admission"),
        (other_environment(environment_id, F.col("environment_id"), F.col("granted_environment")),
         "apply connection is a different warehouse/environment")]))
    checked = packed(by_id(by_id(heads, granted, "plan_id"), bound, "admission_id", "left").withColumn("problem", problem), "apply_headers")

    fine = checked.filter("problem is null")
    items = packed(_executable(art, fine.select("plan_id", "admission_id")), "apply_items")
    forget(art.plans, art.items, art.evaluations)
    shape = items.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "action_id", "table"))), lambda s: F.struct(
        s["action_id"].alias("action_id"), s["table"].alias("table"))).alias("steps"))
    asked = fine.join(shape, "plan_id", "left").select(
        "admission_id", "plan_id", "quality_run_id", "plan_fingerprint", "admission_fingerprint",
        F.coalesce("steps", F.array().cast("array<struct<action_id:string,table:string>>")).alias("steps"))
    known = packed(recover(asked, store.apply_log()), "recovered")
    recovered = _recovered(known, checked, store)
    open_ = fine.join(known.select("admission_id"), "admission_id", "left_anti")
    out_of_time = lambda now: expired(F.lit(now).cast("timestamp"), F.col("expires_at"))
    start = clock()
    late = open_.filter(out_of_time(start)).withColumn("problem", F.lit(EXPIRED))
    open_ = packed(open_.filter(~out_of_time(start)), "open")
    done = [_outcomes(checked.filter("problem is not null").withColumn("outcome", F.lit("refused"))),
            _outcomes(late.withColumn("outcome", F.lit("refused"))), recovered]
    if open_.isEmpty():
        return packed(reduce(DataFrame.unionByName, done), "outcomes")

    attempt = uuid.uuid4().hex
    items = packed(items.join(open_.select("plan_id"), "plan_id", "left_semi"), "open_items")
    none = F.array().cast(STEP_TYPE)
    try:
        written = _staged(items, registry, frames, store, run_id, attempt, clock)
        compared = items.join(written, ["admission_id", "item_id"], "left").withColumn("rowcount", F.coalesce("written", F.lit(0))).withColumn(
            "same", (F.col("rowcount") == F.col("target_count")) & (F.col("target_fingerprint") == F.coalesce(
                "written_fingerprint", empty_set_digest(column="concat(`table`, '|', action_id)"))))
        per_plan = _per_plan(compared)
        tried = packed(open_.join(per_plan, "plan_id", "left").withColumn("steps", F.coalesce("steps", none)), "tried")
    except Exception:
        _fail(open_.withColumn("steps", none), store, run_id, clock())
        raise
    now = clock()
    agreed = F.coalesce("same", F.lit(True)) & ~out_of_time(now)
    rows, events = _evidence(tried.filter(agreed), run_id, False, "apply_succeeded", [], now)
    entries = packed(rows.select(
        "run_id", F.lit("whole_plan").alias("action_id"), F.lit("multiple").alias("table_name"), "plan_id", "admission_id",
        F.lit("whole-plan").alias("item_id"), F.coalesce("target_count", F.lit(0)).alias("target_count"),
        F.coalesce("target_fingerprint", empty_set_digest("targets")).alias("target_fingerprint"), "rowcount", "applied_at", "event_id",
        "apply_result_id", "result_fingerprint", "admission_fingerprint", "steps", F.lit(attempt).alias("attempt"), "expires_at"), "entries")
    filled = [f"filled/{row['table']}" for row in items.filter("action_id = 'null_fill'").select("table").distinct().collect()]
    files = store.files_of(attempt, *COPY_TABLES, *filled)
    last = clock()
    committed = store.append_log(entries.filter(~out_of_time(last)).drop("expires_at"), files)
    store.append_events(events.join(committed.select("apply_result_id"), "apply_result_id", "left_semi"), now)
    failed = packed(tried.filter(~agreed | out_of_time(last)).withColumn(
        "problem", F.when(F.coalesce("same", F.lit(True)), EXPIRED).otherwise(CHANGED)), "failed")
    if not failed.isEmpty():
        _fail(failed, store, run_id, last)
    done += [_outcomes(committed.withColumn("outcome", F.lit("applied"))), _outcomes(failed.withColumn("outcome", F.lit("refused")))]
    rivals = entries.filter(~out_of_time(last)).join(committed.select("admission_id"), "admission_id", "left_anti").select("admission_id")
    if not rivals.isEmpty():
        lost = packed(recover(asked.join(rivals, "admission_id", "left_semi"), store.apply_log()), "lost")
        done.append(_recovered(lost, checked, store))
    return packed(reduce(DataFrame.unionByName, done), "outcomes")


def _per_plan(compared: DataFrame) -> DataFrame:
    """Per plan: whether all items were written as admitted, its steps, and its totals as ``result_totals`` has them."""
    hashed = compared.withColumn("item_hash", row_hash(F.concat_ws("|", "item_id", "target_fingerprint")))
    return hashed.groupBy("plan_id").agg(
        F.bool_and("same").alias("same"), _steps(F.col("rowcount")).alias("steps"), F.sum("target_count").alias("target_count"),
        F.sum("rowcount").alias("rowcount"), set_digest("item_hash", "targets").alias("target_fingerprint"))


def _fail(rows: DataFrame, store: Store, run_id: str, now: datetime) -> None:
    store.append_events(_evidence(rows, run_id, False, "apply_failed", [FAILED_REASON], now)[1], now)


def _recovered(known: DataFrame, checked: DataFrame, store: Store) -> DataFrame:
    """Outcomes of admissions that were committed before. Their events are stored again, in case the attempt that
    committed them ended before that; ids follow from content, so one that is stored changes nothing."""
    if known.isEmpty():
        return config_frame(store.spark, [], OUTCOME)
    bad = known.filter("problem is not null").withColumn("problem", F.concat(
        F.lit("committed result does not bind the supplied payloads ("), F.col("problem"), F.lit(")")))
    good = known.filter("problem is null")
    log = store.apply_log().select("admission_id", "applied_at")
    again = good.select("admission_id", "run_id", "steps", "apply_result_id", "event_id").join(
        checked.drop("problem"), "admission_id").join(log, "admission_id").withColumn("dry_run", F.lit(False)).withColumn(
        "result_fingerprint", result_fingerprint()).withColumn("previous_id", F.col("decision_event_id")).withColumn(
        "reasons", F.array().cast("array<string>"))
    told = apply_events(again.withColumn("run_id", F.col("quality_run_id")), "apply_succeeded")
    store.append_events_at(told.join(good.select("event_id"), "event_id", "left_semi").join(
        again.select("apply_result_id", F.col("applied_at").alias("occurred_at")), "apply_result_id"))
    return _outcomes(good.withColumn("outcome", F.lit("recovered"))).unionByName(_outcomes(bad.withColumn("outcome", F.lit("refused"))))


# -- one plan -----------------------------------------------------------------------------


def _result(row, dry: bool, what: str) -> ApplyResult:
    if row.outcome == "refused":
        recovery = " recovery" if row.problem.startswith("committed result") else ""
        raise ApplyRefused(f"Refusing {what}{recovery}: {row.problem}")
    return ApplyResult(
        row.plan_id, row.run_id, dry, row.admission_id, row.apply_result_id, row.result_fingerprint, row.event_id,
        [step.asDict() for step in row.steps], row.outcome == "recovered")


def dry_run(art: Artifacts, plan_id: str, registry: Registry, frames: Mapping[str, DataFrame],
            store: Store, run_id: str, now: datetime | None = None) -> ApplyResult:
    """Verify and recheck targets; report estimated rows; write one ``dry_run`` event only."""
    ids = config_frame(store.spark, [(plan_id,)], "plan_id string")
    return _result(dry_run_plans(art, ids, registry, frames, store, run_id, now).head(), True, "dry run")


def apply_plan(
    art: Artifacts,
    plan_id: str,
    admission: DataFrame,
    registry: Registry,
    frames: Mapping[str, DataFrame],
    store: Store,
    run_id: str,
    environment_id: str,
    clock: Callable[[], datetime] | None = None,
) -> ApplyResult:
    """Apply one admitted plan, or return the result an earlier attempt committed."""
    row = apply_plans(
        art, admission.filter(F.col("plan_id") == plan_id), registry, frames, store, run_id, environment_id, clock).head()
    if row is None:
        raise ApplyRefused("Refusing apply: mutation requires an apply admission")
    return _result(row, False, "apply")
