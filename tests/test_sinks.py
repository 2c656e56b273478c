import json
import subprocess
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from rowwarden.operators import lineage, suite
from rowwarden.quality import run_quality_suite
from rowwarden.sources import warehouse
from rowwarden.sources.sinks import Store
from rowwarden.streaming.rows import append_stream, failing_stream

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)


def test_check_runs_replace_their_own_run(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frames = {"ext_invoice": warehouse.external_invoice(spark)}
    results = suite.run_suite(warehouse.invoice_registry(), frames, spark)
    for run in ("a", "b", "a"):
        store.record_check_runs(results.withColumn("run_id", F.lit(run)), "rep", AT)
    rows = store.check_runs().collect()
    assert sorted(r.run_id for r in rows) == ["a", "b"]
    assert set(rows[0].__fields__) == {"run_id", "report_id", "check_id", "contract_id", "status", "n_failed",
                                       "n_total", "recorded_at"}


def test_events_are_appended_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    reports = spark.createDataFrame([(f"r{n}", "rep", "f") for n in range(5)],
                                    "run_id string, report_id string, report_fingerprint string")
    events = lineage.report_events(reports)
    store.append_events(events.filter("quality_run_id < 'r3'"), AT)
    store.append_events(events.union(events), AT)
    kept = store.events()
    assert kept.count() == 5 and kept.select("event_id").distinct().count() == 5
    store.export_jsonl(kept, str(tmp_path / "mirror"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "mirror")).collect()]
    assert len(lines) == 5 and list(lines[0]) == sorted(lines[0])


def test_quality_job_records_itself(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frames = {"ext_invoice": warehouse.external_invoice(spark)}
    report = run_quality_suite(warehouse.invoice_registry(), frames, store, "run-1", AT)
    assert report.exit_code == 1 and report.outcome_summary == "completed: 0 passed, 1 failed, 0 errors"
    assert store.check_runs().count() == 1
    event = store.events().head()
    assert (event.kind, event.event_id, event.report_fingerprint) == (
        "quality_report", report.audit_event_id, report.fingerprint)
    again = run_quality_suite(warehouse.invoice_registry(), frames, store, "run-1", AT)
    assert again.audit_event_id == report.audit_event_id and store.events().count() == 1


def test_report_fingerprint_is_canonical_json(spark):
    import hashlib

    rows = spark.createDataFrame([("run", 1, "b", "w.t", "pass", 0, 5), ("run", 0, "a", "w.t", "fail", 2, 5)],
                                 "run_id string, ordinal int, check_id string, contract_id string, status string,"
                                 " n_failed long, n_total long")
    body = {"quality_run_id": "run", "checks": [
        {"check_id": "a", "contract_id": "w.t", "status": "fail", "n_failed": 2, "n_total": 5},
        {"check_id": "b", "contract_id": "w.t", "status": "pass", "n_failed": 0, "n_total": 5}]}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    assert suite.report_fingerprints(rows).head().report_fingerprint == (
        "sha256:" + hashlib.sha256(text.encode()).hexdigest())


def test_row_checks_on_a_stream(spark, tmp_path):
    import pytest

    registry = warehouse.registry()
    source = str(tmp_path / "in")
    orders = warehouse.orders(spark.range(1, 201))
    orders.write.parquet(source)
    stream = spark.readStream.schema(orders.schema).parquet(source)
    failing = failing_stream(registry, "fact_orders.status.validity", stream)
    query = append_stream(failing, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.order_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [9101, 9102, 9103]
    with pytest.raises(ValueError):
        failing_stream(registry, "fact_orders.order_nk.uniqueness", stream)


def test_a_later_recording_replaces_a_run(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "c1", "k", "pass", 0, 5), ("a", "c2", "k", "fail", 1, 5)],
                                 "run_id string, check_id string, contract_id string, status string, n_failed long, n_total long")
    store.record_check_runs(rows, "rep", AT)
    store.record_check_runs(rows.filter("check_id = 'c1'").withColumn("n_failed", F.lit(3).cast("long")), "rep", AT + timedelta(hours=1))
    assert [(r.check_id, r.n_failed) for r in store.check_runs().collect()] == [("c1", 3)]


def test_stored_tables_can_be_dropped(tmp_path):
    """In a session of its own process: the folder of one application goes, others stay."""
    code = (
        "import os, sys; sys.path.insert(0, os.getcwd())\n"
        "from rowwarden.session import drop_stored, local_session, stored\n"
        f"spark = local_session(1, **{{'spark.checkpoint.dir': {str(tmp_path)!r}}})\n"
        "assert stored(spark.range(3), 'x').count() == 3\n"
        f"os.makedirs({str(tmp_path)!r} + '/rowwarden/other'); drop_stored(spark)\n"
        f"assert os.listdir({str(tmp_path)!r} + '/rowwarden') == ['other']; print('fine')")
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "fine" in ran.stdout, ran.stderr[-2000:]
