import json

import pytest
from pyspark.sql import functions as F

from rowwarden.operators import proposals, scoring, suite
from rowwarden.sources import replay, warehouse as source

REG = source.registry()
ACTION_TYPE = ("proposal_id string, run_id string, ordinal long, action_id string,"
               " evidence array<struct<check_id:string,contract_id:string>>")


@pytest.fixture(scope="module")
def results(spark, warehouse, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("results") / "r")
    suite.run_suite(REG, warehouse, spark).withColumn("run_id", F.lit("red")).write.parquet(path)
    red = spark.read.parquet(path)
    green = red.withColumn("run_id", F.lit("green")).withColumn("status", F.lit("pass"))
    gap = red.withColumn("run_id", F.lit("gap")).withColumn(
        "status", F.when(F.col("ordinal") == 3, "error").otherwise(F.col("status")))
    return red.unionByName(green).unionByName(gap)


def ev(*checks):
    return [(c, f"warehouse.{c.split('.')[0]}") for c in checks]


def scored(spark, results, actions, pairs):
    frame = spark.createDataFrame(actions, ACTION_TYPE)
    heads = spark.createDataFrame(pairs, "proposal_id string, run_id string")
    return scoring.score_proposals(heads, frame, results, REG, spark)


def failed_scores(scores, proposal):
    return {r["name"] for r in scores.filter((F.col("proposal_id") == proposal) & ~F.col("passed")).collect()}


def test_default_proposal_passes(spark, results):
    made = proposals.default_actions(results, REG, spark).withColumn("proposal_id", F.lit("p"))
    assert {r.run_id for r in made.collect()} == {"red"} and made.count() == 12
    heads = spark.createDataFrame([("p", "red")], "proposal_id string, run_id string")
    scores = scoring.score_proposals(heads, made, results, REG, spark)
    assert failed_scores(scores, "p") == set() and scores.count() == 6
    gated = scoring.gate(scores).head()
    assert gated.passed and gated.blocked_reasons == []
    header = {r.run_id: r for r in proposals.default_proposals(results).collect()}
    assert (header["red"].n_actions, header["red"].confidence) == (12, 0.9)
    assert (header["green"].n_actions, header["green"].do_not_apply_reason) == (0, "all checks passed")
    assert header["gap"].do_not_apply_reason == "incomplete quality suite"


def test_evaluation_cases(spark, results):
    amount = "fact_orders.total_amount.completeness"
    scores = scored(spark, results, [
        ("drop", "red", 0, "drop_table", ev(amount)),
        ("spurious", "green", 0, "null_fill", ev(amount)),
        ("partial", "red", 0, "quarantine_nulls", ev(amount)),
        ("slug", "red", 0, "no op", ev(amount)),
    ], [("drop", "red"), ("spurious", "green"), ("partial", "red"), ("slug", "red"), ("none", "green"), ("gap", "gap")])
    assert {"destructive_risk", "allowlist_compliance"} <= failed_scores(scores, "drop")
    assert "groundedness" in failed_scores(scores, "spurious")
    assert failed_scores(scores, "partial") == {"citation_quality", "check_policy"}
    assert "groundedness" in failed_scores(scores, "slug")
    assert failed_scores(scores, "none") == set()
    assert "suite_completeness" in failed_scores(scores, "gap")
    partial = scores.filter("proposal_id = 'partial' and name = 'citation_quality'").head()
    assert partial.score == pytest.approx(1 / 12)


def test_invalid_proposal_scores_zero(spark, results):
    heads = spark.createDataFrame([("p", "green", False)], "proposal_id string, run_id string, valid boolean")
    none = spark.createDataFrame([], ACTION_TYPE)
    scores = scoring.score_proposals(heads, none, results, REG, spark).collect()
    assert {s.score for s in scores} == {0.0} and len(scores) == 6
    assert {s.rationale for s in scores} == {"Invalid candidate.", scoring.RATIONALE["schema_validity"][1]}


@pytest.mark.parametrize("action, evidence, refusal", [
    ("quarantine_nulls", [], "no_evidence"),
    ("quarantine_nulls", [("nope", "warehouse.x")], "unknown_check"),
    ("quarantine_nulls", ev("dim_site.schema_drift"), "not_failed"),
    ("quarantine_nulls", [("dim_patient.sex.completeness", "other.dim_patient")], "not_failed"),
    ("quarantine_nulls", [("nope", "x"), *ev("dim_site.schema_drift")], "unknown_check"),
    ("quarantine_nulls", [*ev("dim_site.schema_drift"), ("nope", "x")], "not_failed"),
    ("drop_table", ev("dim_patient.sex.completeness"), "not_governed"),
    ("null_fill", ev("dim_patient.sex.completeness"), "not_declared"),
    ("quarantine_nulls", ev("dim_patient.sex.completeness", "fact_orders.total_amount.completeness"), "incompatible"),
    ("quarantine_nulls", ev("dim_patient.sex.completeness"), None),
])
def test_refusals(spark, results, action, evidence, refusal):
    frame = spark.createDataFrame([("p", "red", 0, action, evidence)], ACTION_TYPE)
    assert proposals.justify(frame, results, REG, spark).head().refusal == refusal


def test_justify_hot_run(spark, results, no_broadcast):
    """The shuffled and the hot path judge alike."""
    actions = spark.range(0, 400).select(
        F.col("id").cast("string").alias("proposal_id"),
        F.when(F.col("id") % 4 > 0, "red").otherwise("green").alias("run_id"), F.lit(0).cast("long").alias("ordinal"),
        F.lit("quarantine_nulls").alias("action_id"),
        F.expr("array(named_struct('check_id', 'dim_patient.sex.completeness', 'contract_id', 'warehouse.dim_patient'))"
               ).alias("evidence"))
    for hot_rows in (10, 10**6):
        judged = proposals.justify(actions, results, REG, spark, hot_rows=hot_rows)
        assert {(r.run_id, r.refusal): r["count"] for r in judged.groupBy("run_id", "refusal").count().collect()} == {
            ("red", None): 300, ("green", "not_failed"): 100}


def test_bounded_projection(spark, results):
    frame = spark.createDataFrame([
        ("good", "red", 0, "quarantine_nulls", ev("dim_patient.sex.completeness")),
        ("bad", "red", 0, "quarantine_nulls", ev("dim_patient.sex.completeness")),
        ("bad", "red", 1, "drop_table", ev("dim_patient.sex.completeness"))], ACTION_TYPE)
    judged = proposals.justify(frame, results, REG, spark)
    assert [r.proposal_id for r in proposals.bounded_actions(judged).collect()] == ["good"]
    assert {r.proposal_id: r.refused for r in proposals.bounded_proposals(judged).collect()} == {
        "good": False, "bad": True}


PROPOSAL = {"summary": "s", "root_cause_hypothesis": "r", "confidence": 0.8, "candidate_actions": [
    {"action_id": "quarantine_nulls", "rationale": "q",
     "evidence": [{"check_id": "dim_patient.sex.completeness", "contract_id": "warehouse.dim_patient"}]}]}


def test_replay_files(spark, tmp_path):
    first, last = {**PROPOSAL, "summary": "first"}, {**PROPOSAL, "summary": "last"}
    lines = [{"kind": "x"}, {"proposal": first}, {"proposal": last}, {"kind": "y"}, {"proposal": None}]
    (tmp_path / "trace.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (tmp_path / "empty.jsonl").write_text(json.dumps({"kind": "x"}) + "\n" + json.dumps({"kind": "y"}))
    (tmp_path / "torn.jsonl").write_text(json.dumps({"proposal": first}) + "\n{torn")
    got = {r.source.rsplit("/", 1)[1]: r for r in replay.parse_proposals(
        replay.replay(replay.read_lines(spark, str(tmp_path)))).collect()}
    assert got["trace.jsonl"].parsed.summary == "last" and got["trace.jsonl"].valid
    assert got["empty.jsonl"].problem == "no proposal envelope"
    assert got["torn.jsonl"].problem == "a line is not JSON"
    one = tmp_path / "one"
    one.mkdir()
    (one / "bare.json").write_text(json.dumps(PROPOSAL, indent=2))
    (one / "envelope.json").write_text(json.dumps({"kind": "k", "proposal": last}, indent=2))
    parsed = replay.parse_proposals(replay.replay(replay.read_documents(spark, str(one))))
    assert {r.source.rsplit("/", 1)[1]: r.parsed.summary for r in parsed.collect()} == {
        "bare.json": "s", "envelope.json": "last"}
    actions = replay.proposal_actions(parsed, "source")
    assert {r.action_id for r in actions.collect()} == {"quarantine_nulls"}


def test_failure_digest(spark, results):
    digest = {r.run_id: r for r in proposals.failure_digest(results).collect()}
    assert [x["check_id"] for x in json.loads(digest["red"].failed_checks)][:2] == [
        "fact_orders.total_amount.completeness", "fact_orders.status.validity"]
    assert digest["green"].failed_checks == "[]"
    assert len(json.loads(digest["gap"].errored_checks)) == 1
