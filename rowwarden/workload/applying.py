"""Registered queries for dry runs and applies of many plans at once.

One plan of every complete run is admitted and applied twice: first while the prices of urgent orders are
missing, so that plans about prices are refused, then over the data they were compiled from. Some
admissions are over. What a reader sees afterwards is compared with SQL over the given tables.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowwarden.operators.joins import by_id
from rowwarden.plans import admission, apply
from rowwarden.session import packed
from rowwarden.sources.sinks import Store
from rowwarden.workload import corpus, governance
from rowwarden.workload.base import query
from rowwarden.workload.corpus import with_corpus
from rowwarden.workload.governance import BASE, FAULTS, GOOD, REG
from rowwarden.workload.writing import fresh_store

NOW = datetime(2024, 3, 2, 1, tzinfo=timezone.utc)
ENV = "warehouse-a"
OVER = 7  # runs of one remainder have admissions that are over
PRICED = "c0"  # the check whose targets change

KEYS = {
    "c0": "SELECT o_orderkey AS k FROM orders_d WHERE o_totalprice IS NULL",
    "c1": "SELECT o_orderkey FROM orders_d WHERE o_orderstatus NOT IN ('O', 'F')",
    "c2": "SELECT o_orderkey FROM orders_d WHERE o_orderkey NOT IN (SELECT min(o_orderkey) FROM orders_d GROUP BY o_custkey, o_orderdate)",
    "c4": "SELECT o_orderkey FROM orders_d WHERE cust_nk IS NULL",
    "c5": "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')",
    "c6": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY text)",
}
SETS = "g_sets AS (SELECT check_id, count(*) AS n, sum(k)::BIGINT AS key_sum FROM (" + " UNION ALL ".join(
    f"SELECT '{check}' AS check_id, k FROM ({sql}) x(k)" for check, sql in KEYS.items()) + ") GROUP BY check_id)"
# the admitted plan of each complete run: the first whose decision has no fault
CHOSEN = f"""g_chosen AS (
  SELECT p.run_id, min(p.proposal_id) AS proposal_id, p.run_id % {OVER} = 3 AS over,
         EXISTS (SELECT 1 FROM g_failed f WHERE f.run_id = p.run_id AND f.check_id = '{PRICED}') AS priced
  FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id AND NOT r.incomplete JOIN g_faults f ON f.proposal_id = p.proposal_id
  WHERE f.fault NOT BETWEEN 1 AND 11 GROUP BY p.run_id)"""
LATE, MOVED = "apply admission has expired", "controlled target set changed after plan compilation"


def _with(sql: str) -> str:
    return with_corpus(sql, *BASE, more=f"{GOOD}, {FAULTS}, {CHOSEN}, {SETS}", views_needed=("orders_d",))


def _changed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    frames = corpus.frames(spark, sf_dir)
    lost = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_totalprice"))
    return {**frames, "t0": frames["t0"].withColumn("o_totalprice", lost)}


def _artifacts(spark: SparkSession, sf_dir: str) -> apply.Artifacts:
    art = governance.artifacts(spark, sf_dir)
    return apply.Artifacts(*[art[name] for name in ("plans", "items", "evaluations", "reports", "results")])


def _admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admission of one plan per run; some end before ``NOW``."""
    checked, art = governance._refusals(spark, sf_dir)
    granted = by_id(admission.admit(checked), art["plans"].select("plan_id", "proposal_id"), "plan_id")
    first = Window.partitionBy("run_id").orderBy("proposal_id")  # plans of one run
    chosen = granted.withColumn("place", F.row_number().over(first)).filter("place = 1")
    ends = F.when(F.col("run_id") % OVER == 3, F.lit(NOW).cast("timestamp")).otherwise(F.col("expires_at"))
    return chosen.withColumn("expires_at", ends).withColumn("fingerprint", admission.admission_fingerprint())


@lru_cache(maxsize=4)
def applied(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame, DataFrame, DataFrame]:
    """A store after two applies, its admissions, and the outcomes of both."""
    store, art = fresh_store(spark), _artifacts(spark, sf_dir)
    admissions = packed(_admissions(spark, sf_dir), "admissions")
    outcomes = [apply.apply_plans(art, admissions, REG, frames, store, f"apply-{n}", ENV, lambda: NOW)
                for n, frames in enumerate((_changed(spark, sf_dir), corpus.frames(spark, sf_dir)), start=1)]
    return store, admissions, *outcomes


@query("h1_dry_run", _with(f"""
SELECT p.proposal_id, CASE WHEN r.incomplete THEN 'remediation plan is blocked'
    WHEN f.fault = 1 THEN 'remediation plan fingerprint does not match received payload'
    WHEN f.fault = 2 THEN 'evaluation fingerprint does not match received payload'
    WHEN EXISTS (SELECT 1 FROM g_good g WHERE g.proposal_id = p.proposal_id AND g.check_id = '{PRICED}') THEN '{MOVED}' END AS problem,
  coalesce((SELECT sum(coalesce(s.n, 0)) FROM g_good g LEFT JOIN g_sets s ON s.check_id = g.check_id WHERE g.proposal_id = p.proposal_id), 0)::BIGINT
    AS estimated
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id JOIN g_faults f ON f.proposal_id = p.proposal_id""").replace(
    "SELECT p.proposal_id, CASE", "SELECT proposal_id, problem, CASE WHEN problem IS NULL THEN estimated END AS estimated,"
    " problem IS NULL AS told FROM (SELECT p.proposal_id, CASE", 1) + ")")
def h1_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan, over data in which some prices are gone since: refusals, estimated rows, and events."""
    store, art = fresh_store(spark), _artifacts(spark, sf_dir)
    found = apply.dry_run_plans(art, art.plans.select("plan_id"), REG, _changed(spark, sf_dir), store, "dry", NOW)
    told = store.events().filter("kind = 'dry_run'").select("event_id", F.lit(True).alias("told"))
    rows = by_id(by_id(found, told, "event_id", "left"), art.plans.select("plan_id", "proposal_id"), "plan_id")
    estimated = F.aggregate("steps", F.lit(0).cast("long"), lambda total, step: total + step["estimated_rows"])
    return rows.select("proposal_id", "problem", F.when(F.col("problem").isNull(), estimated).alias("estimated"),
                       F.coalesce("told", F.lit(False)).alias("told"))


@query("h2_apply", _with(f"""
SELECT c.proposal_id, CASE WHEN over OR priced THEN 'refused' ELSE 'applied' END AS first_outcome,
  CASE WHEN over THEN '{LATE}' WHEN priced THEN '{MOVED}' END AS first_problem,
  CASE WHEN over THEN 'refused' WHEN priced THEN 'applied' ELSE 'recovered' END AS second_outcome,
  g.action_id AS reason, CASE WHEN over THEN 0 ELSE coalesce(s.n, 0) END AS n_copies, CASE WHEN over THEN 0 ELSE coalesce(s.key_sum, 0) END AS key_sum
FROM g_chosen c JOIN g_good g ON g.proposal_id = c.proposal_id LEFT JOIN g_sets s ON s.check_id = g.check_id"""))
def h2_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outcomes of each admission and the copies of each of its items: once, whole, or none."""
    store, admissions, first, second = applied(spark, sf_dir)
    items = governance.artifacts(spark, sf_dir)["items"].filter("kind = 'executable'").select("plan_id", "item_id", F.col("action_id").alias("reason"))
    key = F.regexp_extract("pk_json", r":(\d+)", 1).cast("long")
    copies = store.copies_by_item(F.count(F.lit(1)).alias("n_copies"), F.sum(key).alias("key_sum"))
    outcome = lambda rows, name: rows.select(
        "plan_id", F.col("outcome").alias(f"{name}_outcome"), F.col("problem").alias(f"{name}_problem"))
    rows = admissions.select("plan_id", "admission_id", "proposal_id").join(outcome(first, "first"), "plan_id").join(
        outcome(second, "second"), "plan_id").join(items, "plan_id").join(copies, ["admission_id", "item_id"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("proposal_id", "first_outcome", "first_problem", "second_outcome", "reason",
                       F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("key_sum", zero).alias("key_sum"))


@query("a9_apply_log", _with("""
SELECT c.proposal_id, CASE WHEN priced THEN 'apply-2' ELSE 'apply-1' END AS run_id, sum(coalesce(s.n, 0))::BIGINT AS target_count,
  sum(coalesce(s.n, 0))::BIGINT AS rowcount,
  string_agg(g.action_id || '|' || g."table" || '|' || coalesce(s.n, 0) || '|' || coalesce(s.n, 0), ';' ORDER BY g.check_no) AS steps,
  'apply_succeeded' AS kind, TRUE AS decided, TRUE AS intact, CASE WHEN priced THEN 1 ELSE 0 END AS n_failed
FROM g_chosen c JOIN g_good g ON g.proposal_id = c.proposal_id LEFT JOIN g_sets s ON s.check_id = g.check_id WHERE NOT over
GROUP BY c.proposal_id, priced"""))
def a9_apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed entries with their evidence: steps, the event that tells of them and the decision it follows,
    and the failed attempts before."""
    store, admissions, _, _ = applied(spark, sf_dir)
    events = store.events()
    told = events.select("event_id", "kind", F.col("apply_result_fingerprint").alias("told_fingerprint"), "predecessor_ids")
    failed = events.filter("kind = 'apply_failed'").groupBy("plan_id").agg(F.count_distinct("event_id").cast("int").alias("n_failed"))
    log = store.apply_log().join(admissions.select("admission_id", "proposal_id", "decision_event_id"), "admission_id").join(
        told, "event_id", "left").join(failed, "plan_id", "left")
    step = lambda s: F.concat_ws("|", s["action_id"], s["table"], s["estimated_rows"].cast("string"), s["rowcount"].cast("string"))
    return log.select(
        "proposal_id", "run_id", "target_count", "rowcount", F.array_join(F.transform("steps", step), ";").alias("steps"), "kind",
        (F.element_at("predecessor_ids", 1) == F.col("decision_event_id")).alias("decided"),
        F.col("told_fingerprint").eqNullSafe(F.col("result_fingerprint")).alias("intact"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
