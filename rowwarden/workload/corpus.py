"""A governance corpus derived from ``events``: runs, proposals, requests and decisions.

Every event is one requested action; four consecutive events form a proposal and 64 consecutive
proposals share a run, so runs, results and proposals all grow with the events table. In every seventh
run the first check cannot be evaluated. ``SQL`` states the same relations.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.operators.joins import skew_join
from rowwarden.operators.proposals import default_actions
from rowwarden.registry import Registry
from rowwarden.workload import views

CHECKS = 8
EVENTS_A_RUN = 256
RUN_SQL, RUN = f"event_id // {EVENTS_A_RUN}", f"event_id DIV {EVENTS_A_RUN}"  # for the database, for Spark
UNREADABLE = "run_id % 7 = 2 AND k = 0"  # a check of a run, by number, that ends in an error
ACTION = ("CASE event_type WHEN 'signup' THEN 'quarantine_nulls' WHEN 'purchase' THEN 'quarantine_invalids'"
          " WHEN 'view' THEN 'dedupe_keep_min_pk' WHEN 'click' THEN 'no_op_alert' ELSE 'drop_table' END")
# the action each check permits, by check number
PERMITTED = ("quarantine_nulls", "quarantine_invalids", "dedupe_keep_min_pk", "no_op_alert",
             "quarantine_nulls", "quarantine_invalids", "dedupe_keep_min_pk", "no_op_alert",
             "quarantine_nulls")

SQL = {
    "g_actions": f"""SELECT event_id // 4 AS proposal_id, {RUN_SQL} AS run_id,
        event_id % 4 AS ordinal, {ACTION} AS action_id, 'c' || (user_id % 8) AS check_id,
        CASE WHEN event_id % 61 = 0 THEN 'warehouse.wrong' ELSE 'warehouse.t' || (user_id % 8) END AS contract_id
        FROM events""",
    "g_proposals": "SELECT DISTINCT proposal_id, run_id FROM g_actions",
    "g_checks": f"""SELECT run_id, k AS check_no, 'c' || k AS check_id, 'warehouse.t' || (k % 8) AS contract_id,
        't' || (k % 8) AS "table",
        CASE WHEN {UNREADABLE} THEN 'error'
             WHEN (run_id * 7 + k % 8) % 5 = 0 THEN 'fail' ELSE 'pass' END AS status
        FROM (SELECT DISTINCT run_id FROM g_actions), range({CHECKS}) r(k)""",
    "g_results": """SELECT *, CASE status WHEN 'fail' THEN run_id + check_no + 1 ELSE 0 END AS n_failed,
        CASE status WHEN 'error' THEN 0 ELSE 1000 END AS n_total FROM g_checks""",
    "g_failed": "SELECT run_id, check_id, contract_id, check_no, \"table\" FROM g_checks WHERE status = 'fail'",
    "g_runs": """SELECT run_id, count(*) FILTER (WHERE status = 'pass') AS passed,
        count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'error') AS errors,
        count(*) FILTER (WHERE status = 'error') > 0 AS incomplete FROM g_checks GROUP BY run_id""",
    "g_policy": "SELECT 'c' || k AS check_id, k AS check_no, a AS action_id FROM (VALUES "
    + ", ".join(f"({k}, '{a}')" for k, a in enumerate(PERMITTED[:CHECKS])) + ") p(k, a)",
}


def with_corpus(sql: str, *names: str, more: str = "", views_needed: tuple[str, ...] = ()) -> str:
    """Prefix a query with the corpus relations it names, in dependency order."""
    chosen = [f"{name} AS ({body})" for name, body in SQL.items() if name in names]
    chosen = [f"{name} AS ({views.SQL[name]})" for name in views_needed] + chosen
    return f"WITH {', '.join(chosen + ([more] if more else []))} {sql}"


@lru_cache(maxsize=None)
def registry(price: str = "o_totalprice") -> Registry:
    """Eight tables ``t0`` to ``t7`` over whole given tables, one check each, and a second check
    on ``t0`` that allows the same action. ``price`` changes a contract, for drift."""
    columns = {
        0: ["o_orderkey:int64", "o_totalprice:float64"],
        1: ["o_orderkey:int64", "o_orderstatus:utf8"],
        2: ["o_orderkey:int64", "o_custkey:int64", "o_orderdate:datetime"],
        3: ["page_id:int64", "url:utf8"],
        4: ["o_orderkey:int64", "cust_nk:int64"],
        5: ["event_id:int64", "event_type:utf8"],
        6: ["doc_id:int64", "text:utf8"],
        7: ["c_custkey:int64", "c_acctbal:float64"],
    }
    allowed = {"o_orderstatus": ["O", "F"], "event_type": ["view", "click", "purchase", "signup"]}
    rules = {
        0: {"column": "o_totalprice", "dimension": "completeness"},
        1: {"column": "o_orderstatus", "dimension": "validity"},
        2: {"column": "o_orderdate", "dimension": "uniqueness", "business_key": ["o_custkey", "o_orderdate"]},
        3: {"column": "url", "dimension": "validity", "contains": "https://"},
        4: {"column": "cust_nk", "dimension": "completeness"},
        5: {"column": "event_type", "dimension": "validity"},
        6: {"column": "text", "dimension": "uniqueness", "business_key": ["text"]},
        7: {"column": "c_acctbal", "dimension": "completeness"},
        8: {"column": "o_totalprice", "dimension": "completeness"},
    }
    tables = []
    for number, names in columns.items():
        parts = [dict(zip(("name", "dtype"), item.split(":"))) for item in names]
        for part in parts:
            if part["name"] in allowed:
                part["allowed_values"] = allowed[part["name"]]
            if part["name"] == "o_totalprice" and price != "o_totalprice":
                part["description"] = price
        tables.append({"table": f"t{number}", "columns": parts, "primary_key": [parts[0]["name"]]})
    checks = []
    for number, rule in rules.items():
        given = {"parameters": {"business_key": rule["business_key"]}} if "business_key" in rule else {}
        checks.append({"check_id": f"c{number}", "table": f"t{number % 8}", **rule,
                       "policies": [{"action_id": PERMITTED[number], **given}]})
    return Registry.from_document({"tables": tables, "checks": checks}, "corpus")


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = views.frames(spark, sf_dir, only=["orders", "pages", "events", "documents", "customer"])
    source = ("orders", "orders", "orders", "pages", "orders", "events", "documents", "customer")
    return {
        f"t{n}": base[table].select(*registry().contract(f"t{n}").column_names)
        for n, table in enumerate(source)
    }


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.base(spark, sf_dir, "events").withColumn(
        "proposal_id", F.expr("event_id DIV 4")).withColumn("run_id", F.expr(RUN))


def actions(spark: SparkSession, sf_dir: str, several: bool = False) -> DataFrame:
    """Requests with one piece of evidence, or with a second one for every fifth event."""
    number = "user_id % 8"
    wrong = f"IF(event_id % 61 = 0, 'warehouse.wrong', concat('warehouse.t', {number}))"
    one = f"named_struct('check_id', concat('c', {number}), 'contract_id', {wrong})"
    evidence = f"array({one})"
    if several:
        second = ("IF(user_id % 8 = 0, named_struct('check_id', 'c8', 'contract_id', 'warehouse.t0'),"
                  " named_struct('check_id', concat('c', user_id DIV 8 % 8),"
                  " 'contract_id', concat('warehouse.t', user_id DIV 8 % 8)))")
        evidence = f"IF(event_id % 5 = 0, array({one}, {second}), array({one}))"
    return events(spark, sf_dir).select(
        "proposal_id", "run_id", F.expr("event_id % 4").alias("ordinal"),
        F.expr(ACTION).alias("action_id"), F.expr(evidence).alias("evidence"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("proposal_id", "run_id").distinct()


def results(spark: SparkSession, sf_dir: str, checks: int = CHECKS) -> DataFrame:
    """Check results of every run; the ninth check repeats the outcome of the first."""
    runs = events(spark, sf_dir).select("run_id").distinct()
    k = F.col("k")
    status = F.expr(f"CASE WHEN {UNREADABLE} THEN 'error'"
                    " WHEN (run_id * 7 + k % 8) % 5 = 0 THEN 'fail' ELSE 'pass' END")
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(checks - 1))).alias("k")).select(
        "run_id", k.alias("ordinal"), F.concat(F.lit("c"), k.cast("string")).alias("check_id"),
        F.concat(F.lit("t"), (k % 8).cast("string")).alias("table"),
        F.concat(F.lit("col"), k.cast("string")).alias("column"),
        F.lit("completeness").alias("dimension"), status.alias("status"),
        F.when(status == "fail", F.col("run_id") + k + 1).otherwise(0).cast("bigint").alias("n_failed"),
        F.when(status == "error", 0).otherwise(1000).cast("bigint").alias("n_total"),
        F.concat(F.lit("check "), k.cast("string"), F.lit(" "), status).alias("message"),
        F.concat(F.lit("warehouse.t"), (k % 8).cast("string")).alias("contract_id"),
        F.lit("declared rule").alias("predicate"))


def good_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every proposal: exactly the default actions of its run, so its plan can compile."""
    defaults = default_actions(results(spark, sf_dir), registry(), spark).groupBy("run_id").agg(
        F.collect_list(F.struct("ordinal", "action_id", "evidence")).alias("d"))  # one per check
    given = skew_join(proposals(spark, sf_dir), defaults, ["run_id"], "inner")
    return given.select("proposal_id", "run_id", F.explode("d").alias("d")).select(
        "proposal_id", "run_id", F.col("d.ordinal").cast("bigint").alias("ordinal"), "d.action_id", "d.evidence")
