"""One plan end to end: suite, proposal, plan, review, decision, admission, apply, recovery."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rowwarden.operators import lineage, proposals, suite
from rowwarden.operators.remediation import target_sets
from rowwarden.plans import admission, apply, preparation, review
from rowwarden.session import stored
from rowwarden.sources import warehouse
from rowwarden.sources.sinks import Store

REG = warehouse.invoice_registry()
NOW = datetime(2025, 1, 1, 12, tzinfo=timezone.utc)
ENV = "host:1/db"


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("invoice") / "ext_invoice")
    warehouse.external_invoice(spark).write.parquet(path)
    return {"ext_invoice": spark.read.parquet(path)}


@pytest.fixture(scope="module")
def prepared(spark, frames):
    results = stored(suite.run_suite(REG, frames, spark).withColumn("run_id", F.lit("run")), "results")
    heads = spark.createDataFrame([("p", "run")], "proposal_id string, run_id string")
    actions = proposals.default_actions(results, REG, spark).select(
        F.lit("p").alias("proposal_id"), "run_id", "ordinal", "action_id", "evidence")
    ready = preparation.prepare_reviews(heads, actions, results, target_sets(REG, frames, spark), REG, spark, ENV)
    shown = ready.events.filter("kind = 'approval_review'").select("plan_id", F.col("event_id").alias("previous_id"))
    decided = ready.reviews.join(shown, "plan_id").select(
        "plan_id", "run_id", "plan_fingerprint", "evaluation_id", "evaluation_fingerprint", "review_fingerprint",
        "previous_id", F.lit("d").alias("decision_id"), F.lit("Approve").alias("decision"),
        F.lit("ann").alias("actor"), F.lit("fine").alias("note"), F.lit(NOW).alias("decided_at"))
    recorded = stored(review.record_decisions(decided, ["ann"]), "decisions")
    events = ready.events.unionByName(lineage.decision_events(recorded))
    linked = recorded.join(events.filter("decision_id = 'd'").select(
        "plan_id", F.col("event_id").alias("audit_event_id")), "plan_id")
    reports = suite.report_fingerprints(results)
    request = linked.select("plan_id", "decision_id", F.lit(NOW + timedelta(hours=1)).alias("issued_at"))
    checked = admission.admission_refusals(
        request, ready.plans, ready.items, ready.evaluations, linked, ready.reviews, events, reports, results,
        REG, spark)
    assert [r.refusal for r in checked.collect()] == [None]
    art = apply.Artifacts(ready.plans, ready.items, ready.evaluations, reports, results)
    return art, stored(admission.admit(checked), "admissions"), events, ready


def run(spark, prepared, frames, root, *, at=2.0, admissions=None, art=None, env=ENV, run_id="apply-1", registry=REG):
    plan_id = prepared[0].plans.head().plan_id
    clock = at if callable(at) else lambda: NOW + timedelta(hours=at)
    return apply.apply_plan(art or prepared[0], plan_id, admissions or prepared[1], registry, frames,
                            Store(spark, str(root)), run_id, env, clock)


def test_apply_commits_once(spark, prepared, frames, tmp_path):
    store = Store(spark, str(tmp_path))
    before = sorted(map(tuple, frames["ext_invoice"].collect()))
    first = run(spark, prepared, frames, tmp_path)
    assert [(s["estimated_rows"], s["rowcount"]) for s in first.steps] == [(2, 2)] and not first.recovered
    copies = store.quarantine().orderBy("pk_json").collect()
    assert [c.pk_json for c in copies] == ['{"invoice_id":102}', '{"invoice_id":104}']
    assert copies[0].payload == '{"invoice_id":102,"amount":null}'
    assert {(c.table_name, c.reason, c.run_id) for c in copies} == {("warehouse.ext_invoice", "quarantine_nulls", "apply-1")}
    log = store.apply_log().head()
    assert (log.target_count, log.rowcount, log.item_id) == (2, 2, "whole-plan")
    again = run(spark, prepared, frames, tmp_path, run_id="apply-2")
    assert again.recovered and (again.run_id, again.fingerprint, again.steps) == ("apply-1", first.fingerprint, first.steps)
    late = run(spark, prepared, frames, tmp_path, at=100.0)  # recovery works after expiry
    assert late.recovered
    assert store.quarantine().count() == 2 and store.apply_log().count() == 1
    assert [e.kind for e in store.events().collect()] == ["apply_succeeded"]
    assert sorted(map(tuple, frames["ext_invoice"].collect())) == before
    forged = prepared[1].withColumn("fingerprint", F.lit("sha256:x"))
    with pytest.raises(apply.ApplyRefused, match="fingerprint does not match"):
        run(spark, prepared, frames, tmp_path, admissions=forged)


def test_changed_targets_are_refused(spark, prepared, frames, tmp_path):
    store = Store(spark, str(tmp_path))
    changed = {"ext_invoice": frames["ext_invoice"].withColumn(
        "amount", F.when(F.col("invoice_id") == 101, None).otherwise(F.col("amount")))}
    with pytest.raises(apply.ApplyRefused, match="target set changed"):
        run(spark, prepared, changed, tmp_path)
    moved = {"ext_invoice": frames["ext_invoice"].withColumn(
        "amount", F.when(F.col("invoice_id").isin(101, 102), None).otherwise(1.0))}
    with pytest.raises(apply.ApplyRefused, match="target set changed"):  # same count, other keys
        run(spark, prepared, moved, tmp_path)
    assert store.quarantine().isEmpty() and store.apply_log().isEmpty()
    assert {e.kind for e in store.events().collect()} == {"apply_failed"}
    assert run(spark, prepared, frames, tmp_path).steps[0]["rowcount"] == 2
    assert store.quarantine().count() == 2  # the staged leftovers were replaced


def test_time_and_place(spark, prepared, frames, tmp_path):
    with pytest.raises(apply.ApplyRefused, match="expired"):
        run(spark, prepared, frames, tmp_path, at=24.0)
    ticks = iter([1, 1, 1, 30, 30, 30])
    with pytest.raises(apply.ApplyRefused, match="expired"):  # time runs out before the commit
        run(spark, prepared, frames, tmp_path, at=lambda: NOW + timedelta(hours=next(ticks)))
    assert Store(spark, str(tmp_path)).quarantine().isEmpty()
    with pytest.raises(apply.ApplyRefused, match="different warehouse"):
        run(spark, prepared, frames, tmp_path, env="host:2/db")
    with pytest.raises(apply.ApplyRefused, match="requires an apply admission"):
        run(spark, prepared, frames, tmp_path, admissions=prepared[1].filter("false"))


@pytest.mark.parametrize("field, change, message", [
    ("plans", lambda d: d.withColumn("environment_id", F.lit("other")), "plan fingerprint does not match"),
    ("plans", lambda d: d.withColumn("blocked", F.lit(True)), "plan is blocked"),
    ("items", lambda d: d.withColumn("target_count", F.lit(3).cast("long")), "plan fingerprint does not match"),
    ("evaluations", lambda d: d.withColumn("evaluation_id", F.lit("x")), "evaluation fingerprint does not match"),
    ("evaluations", lambda d: d.withColumn("passed", F.lit(False)), "did not pass"),
    ("results", lambda d: d.withColumn("n_failed", F.lit(9).cast("long")), "quality report fingerprint"),
])
def test_tampering_is_refused(spark, prepared, frames, tmp_path, field, change, message):
    import dataclasses

    art = dataclasses.replace(prepared[0], **{field: change(getattr(prepared[0], field))})
    with pytest.raises(apply.ApplyRefused, match=message):
        run(spark, prepared, frames, tmp_path, art=art)


def test_policy_drift_is_refused(spark, prepared, frames, tmp_path):
    from rowwarden import Registry

    other = Registry.from_document({
        "tables": [{"table": "ext_invoice", "primary_key": ["invoice_id"], "columns": [
            {"name": "invoice_id", "dtype": "int64"}, {"name": "amount", "dtype": "float64", "nullable": True}]}],
        "checks": [{"check_id": "ext_invoice.amount.completeness", "table": "ext_invoice", "column": "amount",
                    "dimension": "completeness", "policies": [{"action_id": "quarantine_nulls"}]}]})
    with pytest.raises(apply.ApplyRefused, match="policy snapshot drifted"):
        run(spark, prepared, frames, tmp_path, registry=other)


def test_dry_run_writes_one_event(spark, prepared, frames, tmp_path):
    store = Store(spark, str(tmp_path))
    plan_id = prepared[0].plans.head().plan_id
    result = apply.dry_run(prepared[0], plan_id, REG, frames, store, "dry", NOW)
    assert [(s["estimated_rows"], s["rowcount"]) for s in result.steps] == [(2, None)]
    assert [e.kind for e in store.events().collect()] == ["dry_run"]
    assert store.apply_log().isEmpty() and store.quarantine().isEmpty()
    with pytest.raises(apply.ApplyRefused, match="target set changed"):
        apply.dry_run(prepared[0], plan_id, REG, {"ext_invoice": frames["ext_invoice"].limit(1)}, store, "dry", NOW)


def test_lineage_of_the_run(spark, prepared):
    events = prepared[2]
    assert lineage.chain_problems(events).isEmpty()
    walked = lineage.walk_runs(events).orderBy("depth").collect()
    assert [r.kind for r in walked] == [
        "quality_report", "candidate_proposal", "plan_compiled", "evaluation", "approval_review", "human_approved"]
    assert [r.kind for r in lineage.ordered_run(events, "run").collect()] == [r.kind for r in walked]
    bodies = events.select(F.to_json(F.struct(*events.columns)).alias("body"))
    assert lineage.privacy_findings(bodies).isEmpty()
    body = prepared[3].reviews.head().body
    assert "quarantine_nulls on ext_invoice; mutates=yes; reversible=yes" in body and "count=2" in body
    assert "expires 24 hours after" in body


def test_two_tables_conflict(spark, warehouse):
    """The whole default proposal of the warehouse has several mutating actions per table."""
    from rowwarden.plans import compiler
    from rowwarden.sources import warehouse as source

    registry = source.registry()
    results = stored(suite.run_suite(registry, warehouse, spark).withColumn("run_id", F.lit("w")), "results")
    heads = spark.createDataFrame([("p", "w")], "proposal_id string, run_id string")
    actions = proposals.default_actions(results, registry, spark).select(
        F.lit("p").alias("proposal_id"), "run_id", "ordinal", "action_id", "evidence")
    items = compiler.compile_items(heads, actions, results, target_sets(registry, warehouse, spark), registry, spark)
    rows = {i.evidence[0].check_id: i for i in items.collect()}
    assert len(rows) == 12 and {i.kind for i in rows.values()} == {"executable"}
    assert rows["fact_orders.order_nk.uniqueness"].target_count == 1
    assert rows["dim_customer.schema_drift"].target_count == 0
    conflict = review.plan_conflicts(items).head()
    assert (conflict.ordinal, conflict.conflict) == (1, "conflicting mutating actions on the same table")


def test_event_lost_after_the_commit_is_written_on_recovery(spark, prepared, frames, tmp_path, monkeypatch):
    store, write = Store(spark, str(tmp_path)), Store.append_events
    monkeypatch.setattr(Store, "append_events", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        run(spark, prepared, frames, tmp_path)
    monkeypatch.setattr(Store, "append_events", write)
    assert store.apply_log().count() == 1 and store.events().isEmpty()
    for attempt in ("apply-2", "apply-3"):
        again = run(spark, prepared, frames, tmp_path, run_id=attempt, at=100.0)
        assert again.recovered and [e.event_id for e in store.events().collect()] == [again.event_id]


def test_of_two_rivals_one_commits(spark, prepared, frames, tmp_path, monkeypatch):
    """The second reads the log before the first commits, and reaches the commit after it."""
    store, real = Store(spark, str(tmp_path)), Store.manifests
    first = run(spark, prepared, frames, tmp_path)
    early = []

    def manifests(self):
        early.append(1)
        return real(self).filter("false") if len(early) <= 3 else real(self)

    monkeypatch.setattr(Store, "manifests", manifests)
    second = run(spark, prepared, frames, tmp_path, run_id="apply-2")
    monkeypatch.undo()
    assert len(early) > 5 and second.recovered and second.run_id == first.run_id == "apply-1"
    assert store.apply_log().count() == 1 and store.quarantine().count() == 2
    assert store.staged_copies(store.apply_log().head().attempt).count() == 2
    manifest = store.manifests().collect()
    assert [(m.version, m.n_entries) for m in manifest] == [(1, 1)] and manifest[0].n_files > 0
    assert store._create("apply_log/commits/000000000001.json", "{}") is False
