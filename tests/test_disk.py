"""What a governed apply holds on disk: packed artifacts, no shuffle files of writes that ended, nothing that only led to an artifact."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowwarden import session
from rowwarden.plans import admission
from rowwarden.session import config_frame, forget, packed, stored
from rowwarden.sources.sinks import Store
from rowwarden.workload import governance


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(n).getName() for n in range(found.size())) if name.startswith("shuffle_")}


def tables(spark):
    """(folder, name) of this application's stored tables."""
    top = Path(session._own_folder(spark).removeprefix("file:"))
    return {(path.parent.name, path.name) for path in top.glob("*/*")} if top.exists() else set()


def grouped(spark):
    return spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def test_packed_tables_leave_no_shuffles_and_take_half(spark):
    spark._jvm.System.gc()
    time.sleep(2)
    before, setting = shuffle_files(spark), spark.conf.get(session.CLEANUP, None)
    rows = packed(grouped(spark), "packed")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session.CLEANUP, None) == setting and not session._writers
    plain = stored(grouped(spark), "plain")
    assert sorted(rows.collect()) == sorted(plain.collect()) and rows.schema == plain.schema
    sizes = [sum(Path(name.removeprefix("file:")).stat().st_size for name in frame.inputFiles()) for frame in (rows, plain)]
    assert sizes[0] < 0.65 * sizes[1]
    forget(rows)
    assert not any(name == "packed" for _, name in tables(spark))


def test_the_setting_is_put_back_when_a_write_fails(spark):
    setting = spark.conf.get(session.CLEANUP, None)
    with pytest.raises(Exception, match="bad"):
        packed(spark.range(3).select(F.raise_error(F.lit("bad")).cast("string").alias("x")), "broken")
    assert spark.conf.get(session.CLEANUP, None) == setting and not session._writers


def test_the_store_packs_what_it_appends(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.stage_owners(config_frame(spark, [("s", "a", "i")], "set_id string, admission_id string, item_id string"), "one")
    assert [path.name.endswith(".zstd.parquet") for path in tmp_path.glob("quarantine_owners/*/*.parquet")] == [True]


EVENT = ("event_id string, kind string, decision_outcome string, decision_id string, quality_run_id string, plan_id string, plan_fingerprint string,"
         " decision_actor string, decision_fingerprint string, evaluation_id string, evaluation_fingerprint string, review_fingerprint string,"
         " predecessor_ids array<string>")


def approved(name, **changed):
    row = {"event_id": f"v-{name}", "kind": "human_approved", "outcome": "Approve", "decision": name, "run": "7", "plan": "p", "plan_fp": "pf",
           "actor": "user1", "fp": name, "eval": "e", "eval_fp": "ef", "review": "rf", "before": ["shown"]}
    return tuple((row | changed).values())


def test_a_decision_is_judged_with_its_events(spark):
    names = ("fine", "other", "late", "kind", "actor", "unseen", "alone", "plan", "lost", "blank", "twice", "unsaid")
    decisions = config_frame(spark, [
        (name, "Reject" if name == "other" else "Approve", "user1", "checked", {"blank": " ", "lost": "gone"}.get(name, f"v-{name}"),
         None if name == "unsaid" else "rf") for name in names],
        "decision_id string, decision string, actor string, note string, audit_event_id string, review_fingerprint string").withColumn(
        "decided_at", F.lit("2024-01-01").cast("timestamp")).withColumn("decision_fingerprint", admission.decision_fingerprint())
    prints = {row.decision_id: row.decision_fingerprint for row in decisions.collect()}
    told = {"late": {"review": "later"}, "kind": {"kind": "human_rejected"}, "actor": {"actor": "user2"}, "unseen": {"before": ["none"]},
            "alone": {"before": []}, "plan": {"plan": "q", "before": ["v-fine"]}, "unsaid": {"review": None, "before": ["blankly"]}}
    events = config_frame(spark, [approved(name, **({"fp": prints[name]} | told.get(name, {}))) for name in names if name != "lost"]
                          + [approved("twice", fp=prints["twice"])] + [
        ("shown", "approval_review", None, None, "7", "p", "pf", None, None, "e", "ef", "rf", []),
        ("blankly", "approval_review", None, None, "7", "p", "pf", None, None, "e", "ef", None, [])], EVENT)
    rows = admission.decision_lineage(decisions, events).collect()
    problems = {row.decision_id: row.lineage_problem for row in rows}
    assert problems == {
        "fine": "", "other": admission.NOT_APPROVED, "late": admission.OTHER_REVIEW, "kind": admission.NO_APPROVAL,
        "actor": admission.OTHER_ACTOR, "unseen": admission.NO_REVIEW, "alone": admission.NOT_REVIEWED, "plan": admission.NO_REVIEW,
        "lost": admission.EVENT_LOST, "blank": admission.NO_EVENT, "twice": "", "unsaid": ""}
    assert len(rows) == len(names) + 1  # an event that is stored twice counts twice
    seals = {row.decision_id: (row.v_plan, row.v_eval, row.v_review, row.bound) for row in rows}
    assert seals["fine"] == seals["actor"] and seals["plan"][0] != seals["fine"][0] and seals["plan"][1] == seals["fine"][1]
    assert seals["fine"][3] and not seals["late"][3] and not seals["unsaid"][3] and max(len(seal) for seal in seals["fine"][:3]) == 32


@pytest.fixture
def lake(spark, tmp_path):
    """Four runs of two hundred and fifty-six events and a few rows of the tables that plans are about; event 4 n has user n modulo 16."""
    n = F.col("id")
    spark.range(1024).select(
        n.alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.expr("id DIV 4 % 16").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(40).select(
        n.alias("o_orderkey"), (n % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
        F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(7).select(n.alias("c_custkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(5).select(n.alias("page_id"), F.lit("https://a").alias("url"), F.lit("").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(5).select(n.alias("doc_id"), (n % 3).cast("string").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_only_artifacts_stay_stored_and_refusals_are_whole(spark, lake):
    before = tables(spark)
    checked, art = governance._refusals(spark, lake)
    kept = [name for _, name in tables(spark) - before]
    gone = {"facts", "evaluations", "faults", "bound", "decisions", "linked", "lineage", "asked", "plan_integrity", "drifted", "param_problems", "conflicts"}
    assert not gone & set(kept) and {"stored_plans", "stored_evaluations", "reviews", "linked_decisions", "decision_events", "refusals"} <= set(kept)
    rows = checked.join(art["plans"].select("plan_id", "proposal_id", "run_id", "fault", "blocked"), "plan_id").select(
        "proposal_id", "fault", "blocked", "refusal").collect()
    assert len(rows) == 256 and {row.fault for row in rows} == set(range(16))
    first = "remediation plan fingerprint does not match received payload"
    for row in rows:
        text = first if row.fault == 1 else "remediation plan is blocked" if row.blocked else governance.FAULT_TEXT.get(row.fault)
        assert row.refusal == text, row
    assert art["reviews"].filter("body is null or length(body) < 100").isEmpty()
