"""Registered queries for proposals, scores, plans, admission, apply and audit lineage."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.operators import lineage, scoring, suite
from rowwarden.operators import proposals as prop
from rowwarden.operators.joins import by_id
from rowwarden.operators.remediation import target_sets
from rowwarden.plans import admission, apply, compiler, review
from rowwarden.plans.preparation import prepare_reviews
from rowwarden.session import forget, packed, spread, stored
from rowwarden.sources import replay
from rowwarden.workload import corpus, views
from rowwarden.workload.base import query
from rowwarden.workload.checks import digits_sql, lanes_sql
from rowwarden.workload.corpus import with_corpus

REG = corpus.registry()


# -- reports ----------------------------------------------------------------------------------

OUTCOME = """CASE WHEN errors > 0 THEN 'incomplete: ' ELSE 'completed: ' END || passed || ' passed, ' || failed
 || ' failed, ' || errors || CASE WHEN errors = 1 THEN ' error' ELSE ' errors' END
 || CASE WHEN errors = 0 AND failed = 0 THEN '; all checks passed' ELSE '' END"""


@query("d6_rollup", with_corpus(
    f"SELECT r.run_id, passed, failed, errors, incomplete, coalesce(ids, '') AS failing, {OUTCOME} AS outcome_summary"
    " FROM g_runs r LEFT JOIN (SELECT run_id, string_agg(check_id, ',' ORDER BY check_no) AS ids"
    " FROM g_failed GROUP BY run_id) f ON f.run_id = r.run_id",
    "g_actions", "g_checks", "g_failed", "g_runs"))
def d6_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = suite.roll_up(corpus.results(spark, sf_dir))
    return rolled.select("run_id", "passed", "failed", "errors", "incomplete",
                         F.array_join("failing_check_ids", ",").alias("failing"), "outcome_summary")


@query("d7_exit", with_corpus(
    "SELECT run_id, CASE WHEN incomplete THEN 2 WHEN failed > 0 THEN 1 ELSE 0 END AS exit_code,"
    " CASE WHEN incomplete THEN 'correct check execution or configuration; do not review a remediation plan'"
    " WHEN failed > 0 THEN 'compile and evaluate a remediation plan from failed checks'"
    " ELSE 'no remediation is required' END AS next_step FROM g_runs",
    "g_actions", "g_checks", "g_runs"))
def d7_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = suite.roll_up(corpus.results(spark, sf_dir))
    return suite.exit_category(rolled).select("run_id", "exit_code", "next_step")


@query("d8_report_fingerprint", with_corpus("""
SELECT run_id, 'sha256:' || sha256('{"checks":[' || string_agg('{"check_id":"' || check_id
  || '","contract_id":"' || contract_id || '","n_failed":' || n_failed || ',"n_total":' || n_total
  || ',"status":"' || status || '"}', ',' ORDER BY check_no) || '],"quality_run_id":' || run_id || '}') AS report_fingerprint
FROM g_results GROUP BY run_id""", "g_actions", "g_checks", "g_results"))
def d8_report_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.report_fingerprints(corpus.results(spark, sf_dir))


@query("d9_sample_free", with_corpus("""
SELECT run_id, check_id, "table", 'col' || check_no AS "column", 'completeness' AS dimension, status, n_failed,
 n_total, 'check ' || check_no || ' ' || status AS message, contract_id, 'declared rule' AS predicate
FROM g_results""", "g_actions", "g_checks", "g_results"))
def d9_sample_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreviewed columns are dropped, whatever they are called."""
    dirty = corpus.results(spark, sf_dir).withColumn("sample_failures", F.lit("private")).withColumn(
        "debug_rows", F.lit("private"))
    return suite.sample_free(dirty)


# -- proposals ----------------------------------------------------------------------------------


@query("f1_proposer", with_corpus(
    "SELECT f.run_id, f.check_no AS ordinal, f.check_id, p.action_id FROM g_failed f"
    " JOIN g_runs r ON r.run_id = f.run_id AND NOT r.incomplete JOIN g_policy p ON p.check_id = f.check_id",
    "g_actions", "g_checks", "g_failed", "g_runs", "g_policy"))
def f1_proposer(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prop.default_actions(corpus.results(spark, sf_dir), REG, spark)
    return made.select("run_id", "ordinal", "check_id", "action_id")


@query("f1_proposal_headers", with_corpus(
    "SELECT run_id, CASE WHEN incomplete THEN " + OUTCOME + " WHEN failed = 0 THEN"
    " 'All declared quality checks passed; no remediation is proposed.' ELSE"
    " failed || ' failed checks have deterministic, allow-listed proposals.' END AS summary,"
    " CASE WHEN incomplete OR failed = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence,"
    " CASE WHEN incomplete THEN 0 ELSE failed END AS n_actions FROM g_runs",
    "g_actions", "g_checks", "g_runs"))
def f1_proposal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prop.default_proposals(corpus.results(spark, sf_dir))
    return made.select("run_id", "summary", "confidence", "n_actions")


@query("f2_failure_digest", with_corpus(f"""
SELECT r.run_id, {OUTCOME} AS outcome_summary, coalesce(f.body, '[]') AS failed_checks, coalesce(e.body, '[]') AS errored_checks
FROM g_runs r
LEFT JOIN (SELECT run_id, '[' || string_agg('{{"check_id":"' || check_id || '","table":"' || "table" || '","column":"col'
  || check_no || '","dimension":"completeness","n_failed":' || n_failed || ',"message":"check ' || check_no || ' fail"}}',
  ',' ORDER BY check_no) || ']' AS body FROM g_results WHERE status = 'fail' GROUP BY run_id) f ON f.run_id = r.run_id
LEFT JOIN (SELECT run_id, '[' || string_agg('{{"check_id":"' || check_id || '","table":"' || "table"
  || '","status":"error","message":"check ' || check_no || ' error"}}', ',' ORDER BY check_no) || ']' AS body
  FROM g_results WHERE status = 'error' GROUP BY run_id) e ON e.run_id = r.run_id
""", "g_actions", "g_checks", "g_results", "g_runs"))
def f2_failure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prop.failure_digest(corpus.results(spark, sf_dir))


# every request with the first rule it breaks
JUSTIFIED = """g_judged AS (SELECT a.*, f.check_id IS NOT NULL AS in_failed,
  f.check_id IS NOT NULL AND f.contract_id <> a.contract_id AS mismatched,
  CASE WHEN f.check_id IS NULL OR f.contract_id <> a.contract_id THEN 'not_failed'
       WHEN a.action_id = 'drop_table' THEN 'not_governed'
       WHEN p.action_id <> a.action_id THEN 'not_declared' END AS refusal
  FROM g_actions a LEFT JOIN g_failed f ON f.run_id = a.run_id AND f.check_id = a.check_id
  LEFT JOIN g_policy p ON p.check_id = a.check_id)"""
BASE = ("g_actions", "g_proposals", "g_checks", "g_failed", "g_runs", "g_policy")
PARAMS = {
    "c0": '{"column":"o_totalprice","pk_column":"o_orderkey"}',
    "c1": '{"check_id":"c1","column":"o_orderstatus","pk_column":"o_orderkey"}',
    "c2": '{"business_key":["o_custkey","o_orderdate"],"pk_column":"o_orderkey"}',
    "c3": '{"check_id":"c3"}',
    "c4": '{"column":"cust_nk","pk_column":"o_orderkey"}',
    "c5": '{"check_id":"c5","column":"event_type","pk_column":"event_id"}',
    "c6": '{"business_key":["text"],"pk_column":"doc_id"}',
    "c7": '{"check_id":"c7"}',
}
PARAMS_SQL = "CASE check_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARAMS.items()) + " END"


def _justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prop.justify(corpus.actions(spark, sf_dir), corpus.results(spark, sf_dir), REG, spark)


@query("e10_params", with_corpus(
    f"SELECT a.check_id, a.action_id, CASE WHEN p.check_id IS NOT NULL THEN {PARAMS_SQL.replace('check_id', 'a.check_id', 1)} END AS params,"
    " count(*) AS n_requests FROM g_actions a LEFT JOIN g_policy p ON p.check_id = a.check_id"
    " AND p.action_id = a.action_id GROUP BY ALL", "g_actions", "g_policy"))
def e10_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests bound to the parameters their policy derives; null when it declares none."""
    asked = corpus.actions(spark, sf_dir).groupBy(
        F.col("evidence")[0]["check_id"].alias("check_id"), "action_id").agg(F.count(F.lit(1)).alias("n_requests"))
    policies = REG.policies_frame(spark).select("check_id", "action_id", "params")
    return asked.join(F.broadcast(policies), ["check_id", "action_id"], "left").select(
        "check_id", "action_id", "params", "n_requests")


@query("f3_justify", with_corpus(
    f"SELECT proposal_id, ordinal, refusal, CASE WHEN refusal IS NULL THEN {PARAMS_SQL} END AS params FROM g_judged",
    *BASE, more=JUSTIFIED))
def f3_justify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _justified(spark, sf_dir).select("proposal_id", "ordinal", "refusal", "params")


# two pieces of evidence: the first offending one decides; nine checks, the ninth like the first
SEVERAL = f"""g_nine AS (SELECT run_id, 'c' || k AS check_id, 'warehouse.t' || (k % 8) AS contract_id, 't' || (k % 8) AS home,
  k AS check_no FROM (SELECT DISTINCT run_id FROM g_actions), range(9) r(k)
  WHERE (run_id * 7 + k % 8) % 5 = 0 AND NOT ({corpus.UNREADABLE})),
 g_rules AS (SELECT * FROM (VALUES {", ".join(f"('c{k}', '{a}')" for k, a in enumerate(corpus.PERMITTED))}) v(check_id, allowed)),
 g_two AS (SELECT a.*, event_id, 1 AS place FROM g_actions a JOIN events e ON e.event_id = a.proposal_id * 4 + a.ordinal
   UNION ALL SELECT a.proposal_id, a.run_id, a.ordinal, a.action_id,
     CASE WHEN user_id % 8 = 0 THEN 'c8' ELSE 'c' || ((user_id // 8) % 8) END,
     CASE WHEN user_id % 8 = 0 THEN 'warehouse.t0' ELSE 'warehouse.t' || ((user_id // 8) % 8) END, event_id, 2
   FROM g_actions a JOIN events e ON e.event_id = a.proposal_id * 4 + a.ordinal WHERE event_id % 5 = 0),
 g_each AS (SELECT t.*, f.check_id IS NOT NULL AND f.contract_id = t.contract_id AS fine, r.allowed = t.action_id AS declared, f.home
   FROM g_two t LEFT JOIN g_nine f ON f.run_id = t.run_id AND f.check_id = t.check_id
   LEFT JOIN g_rules r ON r.check_id = t.check_id),
 g_many AS (SELECT proposal_id, run_id, ordinal, any_value(action_id) AS action_id, CASE WHEN NOT bool_and(fine) THEN 'not_failed'
    WHEN any_value(action_id) = 'drop_table' THEN 'not_governed' WHEN NOT bool_and(declared) THEN 'not_declared'
    WHEN count(DISTINCT CASE WHEN check_id = 'c8' THEN 'c0' ELSE check_id END) > 1 THEN 'incompatible' END AS refusal
   FROM g_each GROUP BY proposal_id, run_id, ordinal)"""


@query("f3_justify_several", with_corpus("SELECT proposal_id, ordinal, refusal FROM g_many", *BASE, more=SEVERAL))
def f3_justify_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = prop.justify(corpus.actions(spark, sf_dir, several=True),
                          corpus.results(spark, sf_dir, checks=9), REG, spark)
    return judged.select("proposal_id", "ordinal", "refusal")


@query("f4_bounded", with_corpus("""
SELECT proposal_id, count(*) AS n_actions, bool_or(refusal IS NOT NULL) AS refused,
 CASE WHEN NOT bool_or(refusal IS NOT NULL) THEN 'Candidate Proposal contains ' || count(*) || ' governed action request(s).' END AS summary
FROM g_judged GROUP BY proposal_id""", *BASE, more=JUSTIFIED))
def f4_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prop.bounded_proposals(_justified(spark, sf_dir)).select(
        "proposal_id", "n_actions", "refused", "summary")


# one recorded proposal per event, broken in one of several ways by its user
_CONFIDENCE = "CASE user_id % 7 WHEN 1 THEN '1.5' WHEN 2 THEN '-0.1' ELSE '0.75' END"
_EXTRA = "CASE user_id % 11 WHEN 3 THEN ',\"sql\":\"x\"' ELSE '' END"
_INNER = "CASE user_id % 13 WHEN 4 THEN ',\"table\":\"x\"' ELSE '' END"
_EVIDENCE = ("CASE WHEN user_id % 5 = 2 THEN '[]' WHEN user_id % 17 = 6 THEN '[{\"check_id\":\"\",\"contract_id\":\"k\"}]'"
             " ELSE '[{\"check_id\":\"c0\",\"contract_id\":\"warehouse.t0\"}]' END")
_TEXT = ("concat('{\"summary\":\"s\",\"root_cause_hypothesis\":\"r\",\"confidence\":', " + _CONFIDENCE + ", " + _EXTRA
         + ", ',\"candidate_actions\":[{\"action_id\":\"', event_type, '\",\"rationale\":\"q\",\"evidence\":', " + _EVIDENCE
         + ", " + _INNER + ", '}]}')")
_PROPOSAL = f"CASE WHEN user_id % 19 = 5 THEN concat(event_type, ' {{broken') ELSE {_TEXT} END".replace("{{", "{")


@query("f5_schema_validity", """
SELECT event_id, CASE WHEN user_id % 19 = 5 THEN 'not a JSON object'
  WHEN user_id % 11 = 3 OR user_id % 13 = 4 THEN 'unknown field'
  WHEN user_id % 7 IN (1, 2) THEN 'confidence outside [0, 1]'
  WHEN user_id % 5 = 2 OR user_id % 17 = 6 THEN 'incomplete candidate action' END AS violation FROM events""")
def f5_schema_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.base(spark, sf_dir, "events").select("event_id", F.expr(_PROPOSAL).alias("proposal"))
    return replay.parse_proposals(rows).select("event_id", "violation")


@query("a10_replay", """
SELECT source, count(*) AS n_lines, CASE WHEN bool_or(torn) THEN NULL ELSE max(event_id) FILTER (WHERE carries) END AS event_id,
  CASE WHEN bool_or(torn) THEN 'a line is not JSON'
       WHEN NOT bool_or(carries) THEN 'no proposal envelope' END AS problem
FROM (SELECT event_id, event_id // 10 AS source, user_id % 97 = 3 AS torn,
             user_id % 97 <> 3 AND event_type IN ('view', 'click') AND user_id % 3 = 0 AS carries FROM events)
GROUP BY source""")
def a10_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events make one trace; some carry a proposal, some lines are torn."""
    text = F.expr(
        "CASE WHEN user_id % 97 = 3 THEN concat('{\"kind\":\"', event_type)"
        " WHEN event_type IN ('view', 'click') AND user_id % 3 = 0 THEN concat('{\"kind\":\"candidate_proposal\",\"proposal\":"
        "{\"summary\":\"', event_id, '\"}}') ELSE concat('{\"kind\":\"', event_type, '\"}') END")
    lines = views.base(spark, sf_dir, "events").select(
        F.expr("event_id DIV 10").alias("source"), F.col("event_id").alias("position"), text.alias("text"))
    return replay.replay(lines).select(
        "source", "n_lines", F.get_json_object("proposal", "$.summary").cast("bigint").alias("event_id"), "problem")


# -- scores -------------------------------------------------------------------------------------

FACTS = JUSTIFIED + """, g_facts AS (SELECT p.proposal_id, p.run_id, r.failed AS due, r.incomplete,
   count(DISTINCT j.check_id) FILTER (WHERE in_failed) AS cited, bool_or(NOT in_failed OR mismatched) AS wrong,
   count(DISTINCT j.check_id) FILTER (WHERE refusal IS NULL) AS covered, bool_and(refusal IS NULL) AS legal,
   bool_or(j.action_id = 'drop_table') AS destructive
  FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id JOIN g_judged j ON j.proposal_id = p.proposal_id
  GROUP BY p.proposal_id, p.run_id, r.failed, r.incomplete)"""
SCORE_SQL = {
    "citation_quality": "CASE WHEN due = 0 THEN 0.0 WHEN wrong THEN 0.0 ELSE cited::DOUBLE / due END",
    "groundedness": "CASE WHEN due = 0 THEN 0.0 ELSE 1.0 END",
    "destructive_risk": "CASE WHEN destructive THEN 0.0 ELSE 1.0 END",
    "allowlist_compliance": "CASE WHEN destructive THEN 0.0 ELSE 1.0 END",
    "check_policy": "CASE WHEN legal AND covered = due THEN 1.0 ELSE 0.0 END",
}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_proposals(
        corpus.proposals(spark, sf_dir), corpus.actions(spark, sf_dir), corpus.results(spark, sf_dir), REG, spark)


for _name, _score in (("f6_citation", "citation_quality"), ("f7_groundedness", "groundedness"),
                      ("f8_destructive", "destructive_risk"), ("f9_allowlist", "allowlist_compliance"),
                      ("f10_check_policy", "check_policy")):
    query(_name, with_corpus(
        f"SELECT proposal_id, score, score >= {scoring.THRESHOLDS[_score]} AS passed FROM"
        f" (SELECT proposal_id, ({SCORE_SQL[_score]})::DOUBLE AS score FROM g_facts)", *BASE, more=FACTS))(
        lambda spark, sf_dir, s=_score: _scores(spark, sf_dir).filter(F.col("name") == s).select(
            "proposal_id", "score", "passed"))


@query("f11_gate", with_corpus(
    "SELECT proposal_id, len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS blocked FROM"
    " (SELECT proposal_id, list_filter([" + ", ".join(
        f"CASE WHEN {sql} < {scoring.THRESHOLDS[name]} THEN '{name}' END" for name, sql in SCORE_SQL.items())
    + ", CASE WHEN incomplete THEN 'suite_completeness' END], lambda x: x IS NOT NULL) AS reasons FROM g_facts)",
    *BASE, more=FACTS))
def f11_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = scoring.gate(_scores(spark, sf_dir))
    names = F.transform("blocked_reasons", lambda text: F.substring_index(text, ": ", 1))
    return gated.select("proposal_id", "passed", F.array_join(names, ",").alias("blocked"))


@query("f11_gate_good", with_corpus("""
SELECT p.proposal_id, NOT r.incomplete AS passed,
  CASE WHEN NOT r.incomplete THEN '' WHEN r.failed = 0 THEN 'suite_completeness'
       ELSE 'citation_quality,check_policy,suite_completeness' END AS blocked
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id""", *BASE))
def f11_gate_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default proposals pass every score unless their suite is incomplete."""
    scores = scoring.score_proposals(
        corpus.proposals(spark, sf_dir), corpus.good_actions(spark, sf_dir), corpus.results(spark, sf_dir), REG, spark)
    names = F.transform("blocked_reasons", lambda text: F.substring_index(text, ": ", 1))
    return scoring.gate(scores).select("proposal_id", "passed", F.array_join(names, ",").alias("blocked"))


# -- plans --------------------------------------------------------------------------------------

DUPLICATES = """g_dup AS (SELECT *, count(*) OVER (PARTITION BY proposal_id, action_id, check_id, contract_id) > 1 AS duplicate
  FROM g_judged)"""
REASON = """CASE WHEN r.incomplete THEN 'quality suite is incomplete'
  WHEN d.duplicate THEN 'duplicate candidate action and quality evidence'
  WHEN d.refusal = 'not_failed' THEN 'candidate evidence is invalid for this quality report'
  WHEN d.refusal IS NOT NULL THEN 'requested action is unsupported by the check policy' END"""
ITEMS = JUSTIFIED + ", " + DUPLICATES + f""", g_items AS (
  SELECT d.proposal_id, d.run_id, 'candidate-' || d.ordinal AS item_id, {REASON} AS reason, d.check_id, d.action_id
  FROM g_dup d JOIN g_runs r ON r.run_id = d.run_id
  UNION ALL SELECT DISTINCT p.proposal_id, p.run_id, 'omitted-failures', 'candidate proposal omitted failed-check coverage', NULL, NULL
  FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id AND NOT r.incomplete JOIN g_failed f ON f.run_id = p.run_id
  WHERE NOT EXISTS (SELECT 1 FROM g_actions a WHERE a.proposal_id = p.proposal_id AND a.check_id = f.check_id))"""
TARGET = {
    "c0": "SELECT count(*) FROM orders_d WHERE o_totalprice IS NULL",
    "c1": "SELECT count(*) FROM orders_d WHERE o_orderstatus NOT IN ('O', 'F')",
    "c2": "SELECT count(*) - count(DISTINCT (o_custkey, o_orderdate)) FROM orders_d",
    "c3": "SELECT 0", "c7": "SELECT 0",
    "c4": "SELECT count(*) FROM orders_d WHERE cust_nk IS NULL",
    "c5": "SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')",
    "c6": "SELECT count(*) - count(DISTINCT text) FROM documents",
}
TARGETS = "g_targets AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS check_id, ({sql})::BIGINT AS n" for k, sql in TARGET.items()) + ")"


@lru_cache(maxsize=8)
def run_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target sets of all policies, resolved once for all plans of a session."""
    return stored(target_sets(REG, corpus.frames(spark, sf_dir), spark), "target_sets")


@lru_cache(maxsize=8)
def run_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals and check results of all runs, stored as a process finds them: many steps read them."""
    return stored(spread(corpus.proposals(spark, sf_dir), "proposal_id"), "proposals"), stored(corpus.results(spark, sf_dir), "results")


@lru_cache(maxsize=8)
def good_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of the default proposals, stored likewise."""
    return stored(spread(corpus.good_actions(spark, sf_dir), "proposal_id"), "good_actions")


def _items(spark: SparkSession, sf_dir: str, requested: DataFrame) -> DataFrame:
    proposals, results = run_inputs(spark, sf_dir)
    return compiler.compile_items(proposals, requested, results, run_targets(spark, sf_dir), REG, spark)


@query("g1_duplicates", with_corpus("SELECT proposal_id, ordinal, duplicate FROM g_dup", *BASE,
                                    more=JUSTIFIED + ", " + DUPLICATES))
def g1_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.repeated(corpus.actions(spark, sf_dir)).select("proposal_id", "ordinal", "duplicate")


@query("g2_items", with_corpus(
    "SELECT i.proposal_id, i.item_id, CASE WHEN i.reason IS NULL THEN 'executable' ELSE 'non_executable' END AS kind,"
    " i.reason, CASE WHEN i.reason IS NULL THEN i.action_id END AS action_id,"
    " CASE WHEN i.reason IS NULL THEN t.n END AS target_count"
    " FROM g_items i LEFT JOIN g_targets t ON t.check_id = i.check_id",
    *BASE, more=ITEMS + ", " + TARGETS, views_needed=("orders_d",)))
def g2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = mixed_plans(spark, sf_dir)[1]
    return items.select("proposal_id", "item_id", "kind", "reason", "action_id", "target_count")


# the compiler over nine checks and several pieces of evidence: tables must agree as well
@query("g2_items_several", with_corpus("""
SELECT m.proposal_id, m.ordinal, CASE WHEN r.incomplete THEN 'quality suite is incomplete'
  WHEN count(*) OVER (PARTITION BY m.proposal_id, m.action_id, s.ids) > 1 THEN 'duplicate candidate action and quality evidence'
  WHEN m.refusal = 'not_failed' THEN 'candidate evidence is invalid for this quality report'
  WHEN m.refusal = 'incompatible' THEN 'candidate action is unavailable under the controlled policy'
  WHEN m.refusal IS NOT NULL THEN 'requested action is unsupported by the check policy' END AS reason
FROM g_many m JOIN g_runs r ON r.run_id = m.run_id JOIN (SELECT proposal_id, ordinal,
  string_agg(check_id || contract_id, ',' ORDER BY check_id, contract_id) AS ids FROM g_two GROUP BY ALL) s
  ON s.proposal_id = m.proposal_id AND s.ordinal = m.ordinal""", *BASE, more=SEVERAL))
def g2_items_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = target_sets(REG, corpus.frames(spark, sf_dir), spark)
    items = compiler.compile_items(
        corpus.proposals(spark, sf_dir), corpus.actions(spark, sf_dir, several=True),
        corpus.results(spark, sf_dir, checks=9), sets, REG, spark)
    return items.filter(F.col("ordinal").isNotNull()).select("proposal_id", "ordinal", "reason")


@query("g3_omitted", with_corpus("""
SELECT p.proposal_id, string_agg(f.check_id, ',' ORDER BY f.check_id) AS omitted
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id AND NOT r.incomplete JOIN g_failed f ON f.run_id = p.run_id
WHERE NOT EXISTS (SELECT 1 FROM g_actions a WHERE a.proposal_id = p.proposal_id AND a.check_id = f.check_id)
GROUP BY p.proposal_id""", *BASE))
def g3_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = compiler.omitted_items(corpus.proposals(spark, sf_dir), corpus.actions(spark, sf_dir),
                                    corpus.results(spark, sf_dir), REG, spark)
    return missed.select("proposal_id", F.array_join(
        F.transform("evidence", lambda e: e["check_id"]), ",").alias("omitted"))


@query("g4_plan", with_corpus("""
SELECT p.proposal_id, count(i.item_id) AS n_items, count(i.item_id) FILTER (WHERE i.reason IS NULL) AS n_executable,
  array_to_string(list_sort(list_distinct(list(i.reason) FILTER (WHERE i.reason IS NOT NULL))), ';') AS reasons,
  coalesce(bool_or(i.reason IS NOT NULL), FALSE) AS blocked,
  coalesce(sum(t.n) FILTER (WHERE i.reason IS NULL), 0)::BIGINT AS target_count
FROM g_proposals p LEFT JOIN g_items i ON i.proposal_id = p.proposal_id LEFT JOIN g_targets t ON t.check_id = i.check_id
GROUP BY p.proposal_id""", *BASE, more=ITEMS + ", " + TARGETS, views_needed=("orders_d",)))
def g4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, _ = mixed_plans(spark, sf_dir)
    return plans.select("proposal_id", "n_items", "n_executable",
                        F.array_join("blocked_reasons", ";").alias("reasons"), "blocked", "target_count")


def _plans(spark: SparkSession, sf_dir: str, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored plans and their stored items, as later steps find them."""
    proposals, results = run_inputs(spark, sf_dir)
    items = packed(spread(_items(spark, sf_dir, requested), "plan_id"), "items")
    plans = compiler.roll_up_plans(proposals, requested, results, items, "warehouse-a")
    return packed(spread(plans, "plan_id"), "plans"), items


@lru_cache(maxsize=8)
def good_plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Plans and items of the default proposals: durable artifacts, written once and read by every later step."""
    return _plans(spark, sf_dir, good_requests(spark, sf_dir))


@lru_cache(maxsize=8)
def mixed_plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Plans and items of what was really requested: permitted, refused, repeated, and in unreadable runs."""
    return _plans(spark, sf_dir, corpus.actions(spark, sf_dir))


GOOD = """g_good AS (SELECT p.proposal_id, p.run_id, f.check_id, f.check_no, y.action_id, f."table"
  FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id AND NOT r.incomplete JOIN g_failed f ON f.run_id = p.run_id
  JOIN g_policy y ON y.check_id = f.check_id)"""


@query("g5_evaluation", with_corpus("""
SELECT p.proposal_id, s.name, CASE WHEN s.name = 'plan_compilation' AND r.incomplete THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
  TRUE AS intact FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id,
  (VALUES ('plan_compilation'), ('policy_snapshot'), ('target_set_integrity')) s(name)""", *BASE))
def g5_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, items = good_plans(spark, sf_dir)
    scores = compiler.evaluate_plans(plans, items, REG)
    return by_id(scores, plans.select("plan_id", "proposal_id"), "plan_id").select(
        "proposal_id", "name", "score", "intact")


@query("g6_policy_drift", with_corpus(
    "SELECT proposal_id, check_id, check_id = 'c0' AS drifted FROM g_good", *BASE, more=GOOD))
def g6_policy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans compiled before the contract of ``t0`` changed, checked after it did."""
    items = good_plans(spark, sf_dir)[1]
    return compiler.policy_drift(items, corpus.registry("reworded")).select(
        "proposal_id", F.col("evidence")[0]["check_id"].alias("check_id"), "drifted")


@query("g7_review", with_corpus("""
SELECT g.proposal_id, g.action_id, g."table", g.check_id AS checks, t.n AS target_count,
  g.action_id <> 'no_op_alert' AS mutates, TRUE AS reversible
FROM g_good g JOIN g_targets t ON t.check_id = g.check_id""", *BASE, more=GOOD + ", " + TARGETS, views_needed=("orders_d",)))
def g7_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, items = good_plans(spark, sf_dir)
    shown = review.review_items(items, REG, spark)
    return by_id(shown, plans.select("plan_id", "proposal_id"), "plan_id").select(
        "proposal_id", "action_id", "table", F.array_join("evidence_check_ids", ",").alias("checks"),
        "target_count", "mutates", "reversible")


@query("g7_review_text", with_corpus("""
SELECT p.proposal_id, CASE WHEN r.incomplete OR count(i.reason) > 0 THEN 'failed' ELSE 'passed' END AS verdict,
  count(i.item_id) FILTER (WHERE i.reason IS NULL) AS n_items,
  count(i.item_id) FILTER (WHERE i.reason IS NULL AND i.action_id <> 'no_op_alert') AS n_mutating, TRUE AS asks_note
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id LEFT JOIN g_items i ON i.proposal_id = p.proposal_id
GROUP BY p.proposal_id, r.incomplete""", *BASE, more=ITEMS))
def g7_review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the review text of every plan says, whether or not it passed; ids and digests in it are the engine's own."""
    plans, items = mixed_plans(spark, sf_dir)
    judged = compiler.evaluations(plans, compiler.evaluate_plans(plans, items, REG))
    texts = review.approval_reviews(plans, judged, review.review_items(items, REG, spark))
    body = F.col("body")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("bigint")
    return by_id(texts, plans.select("plan_id", "proposal_id"), "plan_id").select(
        "proposal_id", F.regexp_extract(body, r"(?m)^Evaluation: (\w+)$", 1).alias("verdict"),
        count(r"(?m)^- \w+ on t\d; mutates=").alias("n_items"), count("mutates=yes").alias("n_mutating"),
        body.endswith("Approve the whole plan or reject it. A note is required.").alias("asks_note"))


# executable items as another compiler might have stored them, to look for conflicts in
CONFLICT_ITEMS = f"""g_stored AS (SELECT event_id // 4 AS plan_id, event_id % 4 AS ordinal, {corpus.ACTION} AS action_id,
   't' || (user_id % 3) AS "table", 'c' || (user_id % 5) AS check_id FROM events WHERE event_type <> 'error')"""


@query("g8_conflicts", f"""WITH {CONFLICT_ITEMS},
found AS (
  SELECT plan_id, ordinal, 0 AS rank, row_number() OVER (PARTITION BY plan_id, action_id, "table", check_id ORDER BY ordinal) AS n FROM g_stored
  UNION ALL SELECT plan_id, ordinal, 1, row_number() OVER (PARTITION BY plan_id, check_id ORDER BY ordinal) FROM g_stored
  UNION ALL SELECT plan_id, ordinal, 2, row_number() OVER (PARTITION BY plan_id, "table" ORDER BY ordinal) FROM g_stored
    WHERE action_id <> 'no_op_alert')
SELECT plan_id, ordinal, ['{review.CONFLICTS[0]}', '{review.CONFLICTS[1]}', '{review.CONFLICTS[2]}'][rank + 1] AS conflict
FROM (SELECT plan_id, ordinal, rank, row_number() OVER (PARTITION BY plan_id ORDER BY ordinal, rank) AS k FROM found WHERE n > 1)
WHERE k = 1""")
def g8_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.base(spark, sf_dir, "events").filter("event_type <> 'error'").select(
        F.expr("event_id DIV 4").alias("plan_id"), F.expr("event_id % 4").alias("ordinal"),
        F.lit("executable").alias("kind"), F.expr(corpus.ACTION).alias("action_id"),
        F.expr("concat('t', user_id % 3)").alias("table"),
        F.expr("array(named_struct('check_id', concat('c', user_id % 5), 'contract_id', 'k'))").alias("evidence"))
    return review.plan_conflicts(items).select("plan_id", "ordinal", "conflict")


APPROVERS = tuple(f"user{n}" for n in range(10))
_DECISION = ("CASE event_type WHEN 'view' THEN 'Approve' WHEN 'click' THEN 'Reject' WHEN 'purchase' THEN 'Timeout'"
             " WHEN 'signup' THEN 'Approve' ELSE 'shadow_skip' END")
_ACTOR = ("CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'airflow-timeout'"
          " ELSE concat('user', user_id % 13) END")
_NOTE = "CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'checked' END"


@query("g9_decisions", f"""
SELECT event_id, CASE WHEN decision NOT IN ('Approve', 'Reject', 'Timeout') THEN 'unknown outcome kind'
  WHEN decision = 'Timeout' THEN CASE WHEN actor <> 'airflow-timeout' THEN 'timeout requires no identity' END
  WHEN actor NOT IN ({', '.join(f"'{a}'" for a in APPROVERS)}) THEN 'actor is not allow-listed'
  WHEN decision = 'Approve' AND trim(coalesce(note, '')) = '' THEN 'approval requires a non-empty note' END AS refusal
FROM (SELECT event_id, {_DECISION} AS decision, {_ACTOR} AS actor, {_NOTE} AS note FROM events)""")
def g9_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.base(spark, sf_dir, "events").select(
        "event_id", F.expr(_DECISION).alias("decision"), F.expr(_ACTOR).alias("actor"),
        F.expr(_NOTE).alias("note"), F.col("event_id").cast("string").alias("decision_id"),
        F.col("ts").cast("timestamp").alias("decided_at"))
    return review.record_decisions(rows, APPROVERS).select("event_id", "refusal")


@query("g9_responses", f"""
SELECT event_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN timed_out THEN 'Timeout' WHEN picked = 'Approve' THEN 'Approve'
  ELSE 'Reject' END END AS decision, CASE WHEN problem IS NULL AND NOT timed_out THEN trim(note) END AS note
FROM (SELECT *, CASE WHEN timed_out THEN NULL WHEN picked IS NULL THEN 'chosen_options is required'
    WHEN actor NOT IN ({', '.join(f"'{a}'" for a in APPROVERS)}) THEN 'responder is not an allow-listed user'
    WHEN picked = 'Approve' AND trim(coalesce(note, '')) = '' THEN 'approval requires a non-empty approval_note' END AS problem
  FROM (SELECT event_id, event_type = 'purchase' AS timed_out, CASE event_type WHEN 'view' THEN 'Approve' WHEN 'signup' THEN 'Reject'
    WHEN 'click' THEN 'Approve' END AS picked, 'user' || (user_id % 13) AS actor, {_NOTE} AS note FROM events))""")
def g9_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.base(spark, sf_dir, "events").select(
        "event_id", (F.col("event_type") == "purchase").alias("timed_out"),
        F.expr("CASE event_type WHEN 'view' THEN array('Approve') WHEN 'signup' THEN array('Reject')"
               " WHEN 'click' THEN array('other', 'Approve') END").alias("chosen_options"),
        F.expr("concat('user', user_id % 13)").alias("user_id"), F.expr(_NOTE).alias("approval_note"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("responded_at"),
        F.col("ts").cast("timestamp").alias("received_at"))
    return review.parse_responses(rows, APPROVERS).select("event_id", "problem", "decision", "note")


# -- admission ------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def artifacts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stored artifacts of every default proposal, each damaged in the way its first event says.

    ``fault`` is the user number of the proposal's first event modulo 16. What only leads to an artifact is deleted
    when that is stored.
    """
    results = run_inputs(spark, sf_dir)[1]
    plans, items = good_plans(spark, sf_dir)
    judged = packed(spread(compiler.evaluations(plans, compiler.evaluate_plans(plans, items, REG)), "plan_id"), "evaluations")
    reviews = packed(spread(review.approval_reviews(plans, judged, review.review_items(items, REG, spark)), "plan_id"), "reviews")
    fault = views.base(spark, sf_dir, "events").filter("event_id % 4 = 0").select(
        F.expr("event_id DIV 4").alias("proposal_id"), F.expr("user_id % 16").alias("fault"))
    faults = packed(by_id(plans.select("plan_id", "proposal_id"), fault, "proposal_id").select("plan_id", "fault"), "faults")
    stored_plans = packed(by_id(plans, faults, "plan_id").withColumn(
        "plan_fingerprint", F.when(F.col("fault") == 1, "sha256:forged").otherwise(F.col("plan_fingerprint"))), "stored_plans")
    stored_eval = packed(by_id(judged, faults, "plan_id").withColumn("evaluation_fingerprint", F.when(
        F.col("fault") == 2, "sha256:forged").otherwise(F.col("evaluation_fingerprint"))), "stored_evaluations")
    bound = packed(by_id(reviews, faults, "plan_id").select(
        "plan_id", "run_id", "fault", "plan_fingerprint", "evaluation_id", "evaluation_fingerprint",
        "policy_fingerprint", "review_fingerprint"), "bound")
    forget(judged, faults)
    shown = packed(lineage.review_events(bound.withColumn("previous_id", F.col("evaluation_id"))), "review_events")
    issued = F.lit("2024-03-02 00:00:00").cast("timestamp")
    hours = F.when(F.col("fault") == 10, 1).when(F.col("fault") == 11, -25).otherwise(-2)
    decided = by_id(bound, shown.select("plan_id", F.col("event_id").alias("previous_id")), "plan_id").select(
        "*", compiler.short_id(F.lit("decision"), F.col("plan_id")).alias("decision_id"),
        F.when(F.col("fault") == 3, "Reject").otherwise("Approve").alias("decision"),
        F.lit("user1").alias("actor"), F.lit("checked").alias("note"),
        (issued + F.make_dt_interval(hours=hours)).alias("decided_at"))
    recorded = packed(review.record_decisions(decided, APPROVERS), "decisions")
    forget(bound)
    # the durable event of the decision, with its own faults
    told = recorded.withColumn("actor", F.when(F.col("fault") == 7, "user2").otherwise(F.col("actor"))).withColumn(
        "review_fingerprint", F.when(F.col("fault") == 9, "sha256:other").otherwise(F.col("review_fingerprint"))
    ).withColumn("decision", F.when(F.col("fault") == 6, "Reject").otherwise(F.col("decision")))
    events = packed(lineage.decision_events(told), "decision_events")
    linked = by_id(recorded, events.select("plan_id", F.col("event_id").alias("audit_event_id")), "plan_id")
    linked = linked.withColumn("audit_event_id", F.when(F.col("fault") == 4, " ").when(
        F.col("fault") == 5, "lost").otherwise(F.col("audit_event_id"))).withColumn(
        "note", F.when(F.col("fault") == 8, "rewritten").otherwise(F.col("note")))
    linked = packed(linked, "linked_decisions")
    forget(recorded)
    reports = stored(suite.report_fingerprints(results), "reports")
    return {
        "plans": stored_plans, "items": items, "evaluations": stored_eval, "reviews": reviews,
        "decisions": linked, "events": events.unionByName(shown), "reports": reports, "results": results,
        "requests": linked.select("plan_id", "decision_id").withColumn("issued_at", issued),
    }


@lru_cache(maxsize=8)
def _refusals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    art = artifacts(spark, sf_dir)
    checked = admission.admission_refusals(
        art["requests"], art["plans"], art["items"], art["evaluations"], art["decisions"], art["reviews"],
        art["events"], art["reports"], art["results"], REG, spark)
    return checked, art


FAULT_TEXT = {
    2: "evaluation fingerprint does not match received payload",
    3: "human decision is not an approval",
    4: "human decision has no durable audit event",
    5: "human decision audit event was not found",
    6: "audit event is not a human approval",
    7: "human decision actor does not match audit lineage",
    8: "human decision fingerprint does not match received payload",
    9: "human decision does not bind the reviewed plan",
    10: "human decision timestamp is after admission time",
    11: "apply admission has expired",
}
FAULTS = """g_faults AS (SELECT event_id // 4 AS proposal_id, user_id % 16 AS fault FROM events WHERE event_id % 4 = 0)"""


@query("g10_admission", with_corpus(
    "SELECT p.proposal_id, CASE WHEN fault = 1 THEN 'remediation plan fingerprint does not match received payload'"
    " WHEN r.incomplete THEN 'remediation plan is blocked' "
    + " ".join(f"WHEN fault = {k} THEN '{v}'" for k, v in FAULT_TEXT.items())
    + " END AS refusal FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id"
    " JOIN g_faults f ON f.proposal_id = p.proposal_id", *BASE, more=FAULTS))
def g10_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, art = _refusals(spark, sf_dir)
    return by_id(checked, art["plans"].select("plan_id", "proposal_id"), "plan_id").select("proposal_id", "refusal")


@query("g11_integrity", with_corpus("""
SELECT p.proposal_id, fault <> 1 AS plan_intact, fault <> 2 AS evaluation_intact, fault <> 8 AS decision_intact, TRUE AS report_intact
FROM g_proposals p JOIN g_faults f ON f.proposal_id = p.proposal_id""", *BASE, more=FAULTS))
def g11_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = artifacts(spark, sf_dir)
    checks = art["plans"].select("plan_id", "proposal_id", "run_id")
    for facts in (admission.plan_integrity(art["plans"], art["items"]), admission.evaluation_integrity(art["evaluations"]),
                  art["decisions"].select("plan_id", "decision_id")):
        checks = by_id(checks, facts, "plan_id")
    checks = (
        by_id(checks, admission.decision_integrity(art["decisions"]), "decision_id")
        .join(admission.report_integrity(art["reports"], art["results"]), "run_id"))
    return checks.select("proposal_id", "plan_intact", "evaluation_intact", "decision_intact", "report_intact")


@query("g12_params", with_corpus("""
SELECT p.proposal_id, CASE WHEN fault = 1 THEN 'duplicate executable action and quality evidence'
  WHEN fault = 2 THEN 'Check Policy refused the requested action'
  WHEN fault = 3 THEN 'item parameters do not match Check Policy'
  ELSE 'plan does not cover every failed check in this quality run' END AS problem
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id AND NOT r.incomplete AND r.failed > 0
JOIN g_faults f ON f.proposal_id = p.proposal_id WHERE fault BETWEEN 1 AND 4""", *BASE, more=FAULTS))
def g12_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items repeated, re-labelled, re-parametrised or lost after compilation."""
    plans, items = good_plans(spark, sf_dir)
    fault = views.base(spark, sf_dir, "events").filter("event_id % 4 = 0").select(
        F.expr("event_id DIV 4").alias("proposal_id"), F.expr("user_id % 16").alias("fault"))
    damaged = by_id(items, fault, "proposal_id")
    again = damaged.filter("fault = 1").withColumn("item_id", F.concat("item_id", F.lit("-again")))
    damaged = damaged.filter("fault <> 4").unionByName(again).withColumn(
        "table", F.when(F.col("fault") == 2, "t9").otherwise(F.col("table"))).withColumn(
        "params", F.when(F.col("fault") == 3, "{}").otherwise(F.col("params")))
    found = admission.param_problems(plans, damaged, run_inputs(spark, sf_dir)[1], REG, spark)
    return by_id(found, plans.filter(~F.col("incomplete")).select("plan_id", "proposal_id"), "plan_id").select(
        "proposal_id", "problem")


@query("g13_prepare", with_corpus("""
SELECT 'quality_report' AS kind, count(*) AS n_events FROM g_runs
UNION ALL SELECT 'candidate_proposal', count(*) FROM g_proposals
UNION ALL SELECT CASE WHEN r.incomplete THEN 'plan_blocked' ELSE 'plan_compiled' END, count(*)
  FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id GROUP BY ALL
UNION ALL SELECT 'evaluation', count(*) FROM g_proposals
UNION ALL SELECT 'approval_review', count(*) FROM g_proposals""", *BASE))
def g13_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report, candidate, plan, evaluation and review events of every default proposal."""
    return chain(spark, sf_dir).groupBy("kind").agg(F.count_distinct("event_id").alias("n_events"))


@lru_cache(maxsize=8)
def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, results = run_inputs(spark, sf_dir)
    return stored(prepare_reviews(
        proposals, good_requests(spark, sf_dir), results, run_targets(spark, sf_dir), REG, spark, "warehouse-a").events, "chain")


# -- apply ----------------------------------------------------------------------------------------

# an apply log as earlier runs might have left it
_LOG = ("named_struct('action_id', event_type, 'table', concat('t', user_id % 3), 'estimated_rows', user_id,"
        " 'rowcount', user_id)")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.base(spark, sf_dir, "events").filter("event_type IN ('purchase', 'signup')").select(
        F.expr("IF(user_id % 9 = 0, ' ', concat('a', event_id))").alias("admission_id"),
        F.expr("concat('p', event_id)").alias("plan_id"), F.lit("r1").alias("run_id"),
        F.expr("IF(user_id % 11 = 4, '', concat('x', event_id))").alias("apply_result_id"),
        F.expr("IF(user_id % 13 = 6, NULL, concat('v', event_id))").alias("event_id"),
        F.expr(f"array({_LOG})").cast(apply.STEP_TYPE).alias("steps"),
        F.lit("q1").alias("quality_run_id"), F.lit("pf").alias("plan_fingerprint"),
        F.lit("af").alias("admission_fingerprint"), F.lit(False).alias("dry_run"), "user_id")
    signed = rows.withColumn("result_fingerprint", apply.result_fingerprint())
    return signed.withColumn("result_fingerprint", F.when(F.col("user_id") % 7 == 2, "sha256:forged").otherwise(
        F.col("result_fingerprint")))


@query("h3_consumed", """SELECT event_id FROM events
WHERE event_type IN ('purchase', 'signup') AND user_id % 9 <> 0""")
def h3_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all admissions were used? A blank id never counts as used."""
    asked = views.base(spark, sf_dir, "events").select("event_id", F.expr(
        "IF(user_id % 9 = 0, ' ', concat('a', event_id))").alias("admission_id"))
    return apply.consumed(asked, _log(spark, sf_dir)).select("event_id")


@query("h4_recovery", """
SELECT event_id, CASE WHEN user_id % 10 = 1 THEN 'apply log plan_id does not match'
  WHEN user_id % 10 = 3 THEN 'apply step evidence does not match the supplied plan'
  WHEN user_id % 7 = 2 THEN 'result fingerprint does not match the committed evidence'
  WHEN user_id % 11 = 4 THEN 'apply result id is missing'
  WHEN user_id % 13 = 6 THEN 'audit event id is missing' END AS problem
FROM events WHERE event_type IN ('purchase', 'signup') AND user_id % 9 <> 0""")
def h4_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated requests for all admissions; some do not fit what was committed."""
    asked = views.base(spark, sf_dir, "events").select(
        F.expr("concat('a', event_id)").alias("admission_id"), F.lit("q1").alias("quality_run_id"),
        F.expr("IF(user_id % 10 = 1, 'other', concat('p', event_id))").alias("plan_id"),
        F.lit("pf").alias("plan_fingerprint"), F.lit("af").alias("admission_fingerprint"),
        F.expr("array(named_struct('action_id', event_type, 'table',"
               " IF(user_id % 10 = 3, 'other', concat('t', user_id % 3))))").alias("steps"))
    found = apply.recover(asked, _log(spark, sf_dir))
    return found.select(F.substring("admission_id", 2, 20).cast("bigint").alias("event_id"), "problem")


@query("h5_expiry", """
SELECT event_id, now > expires_at OR floor((epoch_us(expires_at) - epoch_us(now)) / 1000) <= 0 AS expired
FROM (SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at, CASE event_type WHEN 'view' THEN ts + INTERVAL 24 HOUR
  WHEN 'click' THEN ts + INTERVAL 24 HOUR - INTERVAL 900 MICROSECOND ELSE TIMESTAMP '2024-01-15 00:00:00' END AS now FROM events)""")
def h5_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end, within the last millisecond, and around a fixed time."""
    end = F.expr("ts + INTERVAL 24 HOURS")
    now = F.expr("CASE event_type WHEN 'view' THEN ts + INTERVAL 24 HOURS WHEN 'click' THEN"
                 " ts + INTERVAL 24 HOURS - INTERVAL '0.0009' SECOND ELSE TIMESTAMP_NTZ '2024-01-15 00:00:00' END")
    return views.base(spark, sf_dir, "events").select(
        "event_id", apply.expired(now.cast("timestamp"), end.cast("timestamp")).alias("expired"))


@query("h6_environment", """
SELECT event_id, NOT ('wh' || (user_id % 2) = 'wh0' AND 'wh' || (user_id % 3) = 'wh0') AS refused FROM events""")
def h6_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.base(spark, sf_dir, "events").select("event_id", apply.other_environment(
        "wh0", F.expr("concat('wh', user_id % 2)"), F.expr("concat('wh', user_id % 3)")).alias("refused"))


@query("h7_totals", f"""
WITH stored AS (SELECT event_id // 4 AS plan_id, 'candidate-' || (event_id % 4) AS item_id, user_id AS n,
  sha256(event_type) AS fp FROM events WHERE event_type <> 'error'),
h AS (SELECT plan_id, n, {digits_sql("item_id || '|' || fp")} AS x FROM stored)
SELECT plan_id, sum(n)::BIGINT AS target_count, sum(n)::BIGINT AS rowcount,
  'sha256:' || sha256('targets|' || {lanes_sql('x')}) AS target_fingerprint FROM h GROUP BY plan_id""")
def h7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.base(spark, sf_dir, "events").filter("event_type <> 'error'").select(
        F.expr("event_id DIV 4").alias("plan_id"), F.expr("concat('candidate-', event_id % 4)").alias("item_id"),
        F.lit("executable").alias("kind"), F.col("user_id").alias("target_count"),
        F.sha2("event_type", 256).alias("target_fingerprint"))
    return apply.result_totals(items)


# -- audit lineage ----------------------------------------------------------------------------------


# events whose chain is whole, except for what the proposal's first event breaks
def _broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.base(spark, sf_dir, "events").select(
        F.col("event_id"), F.expr(f"cast({corpus.RUN} AS string)").alias("quality_run_id"),
        F.expr("event_id DIV 4").alias("p"), F.expr("event_id % 4").alias("stage"), "user_id")
    kind = F.expr("CASE stage WHEN 0 THEN 'plan_compiled' WHEN 1 THEN 'evaluation' WHEN 2 THEN 'approval_review'"
                  " ELSE 'human_approved' END")
    return rows.select(
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("event_id"), kind.alias("kind"),
        F.when((F.col("stage") == 2) & (F.col("user_id") % 5 == 1), "other").otherwise(
            F.col("quality_run_id")).alias("quality_run_id"),
        F.expr("CASE WHEN user_id % 5 = 2 THEN array() WHEN user_id % 5 = 3 THEN array('lost')"
               " WHEN stage = 0 THEN array('lost') WHEN user_id % 7 = 1 AND stage > 1 THEN array(concat('v', event_id - 2))"
               " ELSE array(concat('v', event_id - 1)) END").alias("predecessor_ids"),
        F.lit("f").alias("plan_fingerprint"),
        F.when(F.col("stage") > 0, F.lit("e")).alias("evaluation_fingerprint"),
        F.when(F.col("stage") == 2, "r").when(F.col("stage") == 3, F.expr("IF(user_id % 11 = 4, 'z', 'r')")
               ).alias("review_fingerprint"))


@query("i3_chain", f"""
WITH v AS (SELECT event_id, event_id % 4 AS stage, user_id, CASE WHEN event_id % 4 = 2 AND user_id % 5 = 1 THEN 'other'
    ELSE ({corpus.RUN_SQL})::VARCHAR END AS run,
  CASE WHEN user_id % 5 = 2 THEN NULL WHEN user_id % 5 = 3 OR event_id % 4 = 0 THEN -1
       WHEN user_id % 7 = 1 AND event_id % 4 > 1 THEN event_id - 2 ELSE event_id - 1 END AS prev FROM events)
SELECT 'v' || v.event_id AS event_id, CASE WHEN v.prev IS NULL THEN 'no predecessor' WHEN p.event_id IS NULL THEN 'predecessor not found'
  WHEN p.stage <> v.stage - 1 THEN 'predecessor has the wrong kind' WHEN p.run <> v.run THEN 'predecessor belongs to another run'
  ELSE 'predecessor fingerprints differ' END AS problem
FROM v LEFT JOIN v p ON p.event_id = v.prev
WHERE v.prev IS NULL OR p.event_id IS NULL OR p.stage <> v.stage - 1 OR p.run <> v.run OR (v.stage = 3 AND v.user_id % 11 = 4)""")
def i3_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.chain_problems(_broken_chain(spark, sf_dir)).select("event_id", "problem")


@query("i1_events", with_corpus("""
SELECT p.run_id, CASE WHEN r.incomplete THEN 'plan_blocked' ELSE 'plan_compiled' END AS kind,
  coalesce(sum(n), 0)::BIGINT AS target_count, count(DISTINCT p.proposal_id) AS n_events
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id
LEFT JOIN (SELECT g.proposal_id, t.n FROM g_good g JOIN g_targets t ON t.check_id = g.check_id) x ON x.proposal_id = p.proposal_id
GROUP BY ALL""", *BASE, more=GOOD + ", " + TARGETS, views_needed=("orders_d",)))
def i1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan events of every proposal, summed per run and kind."""
    plans, _ = good_plans(spark, sf_dir)
    events = lineage.plan_events(plans.withColumn("previous_id", F.lit("c")))
    return events.groupBy(F.col("quality_run_id").cast("bigint").alias("run_id"), "kind").agg(
        F.sum("target_count").alias("target_count"), F.count_distinct("event_id").alias("n_events"))


@query("i2_lookup", """
SELECT w.id AS event_id, e.kind FROM (SELECT DISTINCT 'v' || (event_id + CASE WHEN user_id % 3 = 0 THEN 1000000000 ELSE 0 END) AS id
  FROM events) w LEFT JOIN (SELECT 'v' || event_id AS id, CASE event_id % 4 WHEN 0 THEN 'plan_compiled' WHEN 1 THEN 'evaluation'
  WHEN 2 THEN 'approval_review' ELSE 'human_approved' END AS kind FROM events) e ON e.id = w.id""")
def i2_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.base(spark, sf_dir, "events").select(F.expr(
        "concat('v', event_id + IF(user_id % 3 = 0, 1000000000, 0))").alias("event_id"))
    return lineage.find_events(_broken_chain(spark, sf_dir), wanted).select("event_id", "kind")


@query("i4_walk", with_corpus("""
SELECT run_id, 0 AS depth, 'quality_report' AS kind, 1 AS n FROM g_runs
UNION ALL SELECT p.run_id, d.depth, CASE d.depth WHEN 1 THEN 'candidate_proposal' WHEN 2 THEN
  CASE WHEN r.incomplete THEN 'plan_blocked' ELSE 'plan_compiled' END WHEN 3 THEN 'evaluation' ELSE 'approval_review' END, count(*)
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id, (VALUES (1), (2), (3), (4)) d(depth) GROUP BY ALL""", *BASE))
def i4_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events reached from each run's report, by depth."""
    walked = lineage.walk_runs(chain(spark, sf_dir))
    return walked.groupBy(F.col("quality_run_id").cast("bigint").alias("run_id"), "depth", "kind").agg(
        F.count(F.lit(1)).alias("n"))


@query("i5_privacy", """SELECT event_id FROM events WHERE user_id % 23 = 5 OR (event_type = 'error' AND user_id % 4 = 1)
OR (user_id % 23 = 7 AND NOT (event_type = 'error' AND user_id % 4 = 1)) OR user_id % 23 = 11""")
def i5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bodies that hold a sample at some depth, also under an escaped name or in a torn body. A value that reads
    like a field, and a longer name that ends like one, are none."""
    body = F.expr(
        "CASE WHEN user_id % 23 = 5 THEN concat('{\"kind\":\"quality_report\",\"checks\":[{\"check_id\":\"c\",\"sample_failures\":[', props, ']}]}')"
        " WHEN event_type = 'error' AND user_id % 4 = 1 THEN concat('{\"kind\":\"x\",\"payload\" : ', props, '}')"
        " WHEN user_id % 23 = 7 THEN concat('{\"a\":[1,{\"b\":{\"', r'\\u0070ay\\u006coad', '\":', user_id, '}}]}')"
        " WHEN user_id % 23 = 11 THEN concat('{\"row\": ', user_id, ', \"torn')"
        " WHEN user_id % 23 = 13 THEN concat('{\"note\":\"\\\\\"payload\\\\\": 1\",\"my payload\":1,\"no_row\":', user_id, '}')"
        " ELSE concat('{\"kind\":\"', event_type, '\",\"note\":\"no payload here\",\"n_rows\":', user_id, '}') END")
    bodies = views.base(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return lineage.privacy_findings(bodies).select("event_id")


@query("i6_neighbours", """
WITH e AS (SELECT DISTINCT source, 'documents_' || lang AS target FROM documents)
SELECT source AS "table", 'downstream' AS direction, target AS neighbour FROM e
UNION ALL SELECT target, 'upstream', source FROM e""")
def i6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each document source to the language tables it feeds, both ways."""
    edges = views.base(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit("documents_"), "lang").alias("target"), F.lit("pipeline").alias("kind")).distinct()
    return lineage.neighbours(edges)
