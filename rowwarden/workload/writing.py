"""Registered queries about awkward targets and about what is written and read back.

Each writing query takes a store of its own below the shared checkpoint folder, repeats its
writes as a second attempt would, and returns what a reader then sees.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden import quality
from rowwarden.functions.fingerprint import row_hash, set_digest
from rowwarden.operators import filesets, lineage, proposals, scoring, suite
from rowwarden.operators import remediation as fix
from rowwarden.operators.joins import by_id
from rowwarden.plans import compiler, review
from rowwarden.session import checkpoint_dir, config_frame
from rowwarden.sources.sinks import LOG_FIELDS, Store
from rowwarden.workload import corpus, governance, views
from rowwarden.workload.base import ORACLES, query
from rowwarden.workload.checks import REG, failing_sql, relation, summary_sql, target_sql
from rowwarden.workload.corpus import with_corpus
from rowwarden.workload.views import with_views

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)
NULLS, FILL = ("orders.o_totalprice.completeness", "quarantine_nulls"), ("orders.o_totalprice.completeness", "null_fill")
INVALID, ORPHANS = ("orders.status_nk.validity", "quarantine_invalids"), ("orders.cust_nk.referential_integrity", "quarantine_orphans")
DEDUPE, DEDUPE_TEXTS = ("orders.null_nk.uniqueness", "dedupe_keep_min_pk"), ("documents.text.uniqueness", "dedupe_keep_min_pk")
SUMMARY = ("check_id", "action_id", "target_count", "target_fingerprint")


def fresh_store(spark: SparkSession) -> Store:
    return Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/rowwarden/{uuid.uuid4().hex}/store")


def _over(sql: str) -> str:
    """A statement over the orders view, over rows of which every fifth customer's lack their key."""
    return sql.replace("FROM orders_d", "FROM orders_k")


KEYLESS = ("orders_k AS (SELECT * REPLACE (CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey)"
           " FROM orders_d)")


def keyless(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    loaded = views.frames(spark, sf_dir)
    lost = F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("o_orderkey"))
    return {**loaded, "orders": loaded["orders"].withColumn("o_orderkey", lost)}


@query("e11_null_keys", with_views(
    " UNION ALL ".join(_over(summary_sql(*p)) for p in (NULLS, INVALID, ORPHANS)), "orders_d", more=KEYLESS))
def e11_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows without a primary key are targets like any other."""
    return fix.target_sets(REG, keyless(spark, sf_dir), spark, [NULLS, INVALID, ORPHANS]).select(*SUMMARY)


_ORDERS = [(s.check_id, p.action_id) for s in REG.checks.values() if s.table == "orders" for p in s.policies]
_READABLE = [p for p in _ORDERS if REG.check(p[0]).column != "o_totalprice"]


@query("e11_missing_column", with_views(" UNION ALL ".join(summary_sql(*p) for p in _READABLE), "orders_d"))
def e11_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped column leaves out the policies that name it and no other."""
    loaded = views.frames(spark, sf_dir)
    cut = {**loaded, "orders": loaded["orders"].drop("o_totalprice")}
    return fix.target_sets(REG, cut, spark, _ORDERS).select(*SUMMARY)


@query("e4_key_precondition", with_views(summary_sql(*DEDUPE_TEXTS)))
def e4_key_precondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dedupe whose duplicate rows lack keys has no target set; one with clear keys has."""
    return fix.target_sets(REG, keyless(spark, sf_dir), spark, [DEDUPE, DEDUPE_TEXTS]).select(*SUMMARY)


@query("e3_payload", with_views(
    "SELECT o_orderkey, '" + ",".join(views.ORDERS_COLUMNS) + "' AS names, cust_nk, o_orderpriority FROM orders_d"
    f" WHERE o_orderkey IN (SELECT k FROM ({target_sql(*ORPHANS)}))", "orders_d"))
def e3_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies hold the table's columns in the table's order, whichever join found them."""
    rows = fix.quarantine_rows(REG, *ORPHANS, views.frames(spark, sf_dir), "run-1")
    inside = F.from_json("payload", "o_orderkey bigint, cust_nk bigint, o_orderpriority string")
    return rows.select(inside["o_orderkey"].alias("o_orderkey"), F.array_join(F.json_object_keys("payload"), ",").alias("names"),
                       inside["cust_nk"].alias("cust_nk"), inside["o_orderpriority"].alias("o_orderpriority"))


def log_entry(spark: SparkSession, admission_id: str, targets: DataFrame, attempt: str) -> DataFrame:
    """The commit of one copied item."""
    counted = targets.agg(F.count("*").alias("n"), set_digest("pk_hash", "written").alias("digest"))
    names = [part.split()[0] for part in LOG_FIELDS.split(", ") if " " in part and not part.startswith("rowcount:")]
    values = {"run_id": F.lit("apply-1"), "admission_id": F.lit(admission_id), "target_count": F.col("n"), "rowcount": F.col("n"),
              "target_fingerprint": F.col("digest"), "applied_at": F.lit(AT), "apply_result_id": F.lit(f"result-{admission_id}"),
              "attempt": F.lit(attempt)}
    empty = config_frame(spark, [], LOG_FIELDS)
    return empty.unionByName(counted.select(*[values[n].alias(n) for n in names if n in values]), allowMissingColumns=True)


@query("a6_quarantine", with_views(
    "SELECT '{\"o_orderkey\":' || k || '}' AS pk_json, 'adm-1' AS admission_id, (SELECT count(*) FROM orders_d WHERE "
    f"{failing_sql(NULLS[0])}) AS rowcount FROM ({target_sql(*NULLS)})", "orders_d"))
def a6_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts at one admission and one that never commits: the reader sees the first's copies once."""
    store, loaded = fresh_store(spark), views.frames(spark, sf_dir, only=["orders"])
    copies = fix.quarantine_rows(REG, *NULLS, loaded, "apply-1", pk_hash=True).withColumn("item_id", F.lit("item-1"))
    store.stage_copies(copies.withColumn("admission_id", F.lit("adm-2")), "attempt-0", AT)
    for attempt in ("attempt-1", "attempt-2"):
        staged = store.stage_copies(copies.withColumn("admission_id", F.lit("adm-1")), attempt, AT)
        store.append_log(log_entry(spark, "adm-1", staged, attempt), store.files_of(attempt, "quarantine"))
    log = store.apply_log().select("admission_id", "rowcount")
    return store.quarantine().join(F.broadcast(log), "admission_id").select("pk_json", "admission_id", "rowcount")


@query("a7_check_runs", ORACLES["d1_suite"])
def a7_check_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run recorded twice, beside another one."""
    store = fresh_store(spark)
    results = suite.run_suite(REG, views.frames(spark, sf_dir), spark)
    for run_id in ("run-1", "run-1", "run-2"):
        store.record_check_runs(results.withColumn("run_id", F.lit(run_id)), "report", AT)
    return store.check_runs().filter("run_id = 'run-1'").select("check_id", "status", "n_failed", "n_total")


@query("a8_events", f"SELECT run_id::VARCHAR AS quality_run_id, report_fingerprint FROM ({ORACLES['d8_report_fingerprint']})")
def a8_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report event for each run, appended twice."""
    store = fresh_store(spark)
    events = lineage.report_events(suite.report_fingerprints(corpus.results(spark, sf_dir)).withColumn("report_id", F.lit("r")))
    for _ in range(2):
        store.append_events(events, AT)
    return store.events().select("quality_run_id", "report_fingerprint")


@query("d10_quality_job", with_views(
    "SELECT check_id, status, n_failed, n_total, 1 AS n_events FROM (" + ORACLES["d1_suite"] + ")"))
def d10_quality_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded job, run twice: its check runs, and one report event."""
    store, loaded = fresh_store(spark), views.frames(spark, sf_dir)
    for _ in range(2):
        quality.run_quality_suite(REG, loaded, store, "run-1", AT)
    events = store.events().agg(F.count("*").cast("int").alias("n_events"))
    # one row
    return store.check_runs().join(F.broadcast(events)).select("check_id", "status", "n_failed", "n_total", "n_events")


@query("h2_null_fill", with_views(
    "SELECT o_orderkey, coalesce(o_totalprice, 0.0)::DOUBLE AS o_totalprice, o_totalprice IS NULL AS filled,"
    f" s.target_count, s.target_fingerprint, true AS hidden_before FROM {relation('orders')}, ({summary_sql(*FILL)}) s", "orders_d"))
def h2_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill is written whole, summed up from what was written, and hidden until its commit."""
    store, loaded = fresh_store(spark), views.frames(spark, sf_dir, only=["orders"])
    filled = fix.filled_rows(REG, FILL[0], loaded, mark="filled").withColumn("admission_id", F.lit("adm-1"))
    staged = store.stage_filled(filled, "orders", "attempt-1")
    changed = staged.filter("filled").select(row_hash(F.col("o_orderkey")).alias("pk_hash"))
    written = changed.agg(F.count("*").alias("target_count"), set_digest("pk_hash", fix.label_of("orders", FILL[1])).alias("target_fingerprint"))
    hidden = store.filled("orders").isEmpty()
    store.append_log(log_entry(spark, "adm-1", changed, "attempt-1"))
    # one row
    return store.filled("orders").join(F.broadcast(written)).select(
        "o_orderkey", "o_totalprice", "filled", "target_count", "target_fingerprint", F.lit(hidden).alias("hidden_before"))


_BUCKETS = 8
_LOST = "o_orderkey % 8 = 3 AND o_orderpriority = '1-URGENT'"  # what the rewritten bucket lost
_ROW_POLICIES = [NULLS, ("orders.o_orderstatus.validity", "quarantine_invalids"), INVALID, ("orders.o_orderdate.open_window", "quarantine_invalids")]


def _bucket_sql() -> str:
    later = f"later AS (SELECT * REPLACE (CASE WHEN {_LOST} THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders_d)"
    parts = []
    for check_id, action_id in _ROW_POLICIES:
        keys = target_sql(check_id, action_id)
        parts.append(
            f"SELECT '{check_id}' AS check_id, '{action_id}' AS action_id, coalesce(b.bucket, a.bucket) AS bucket, coalesce(b.n, 0) AS n_before,"
            f" coalesce(a.n, 0) AS n_after, s.target_count, s.target_fingerprint FROM"
            f" (SELECT k % {_BUCKETS} AS bucket, count(*) AS n, list(k ORDER BY k) AS ks FROM ({keys}) GROUP BY ALL) b FULL JOIN"
            f" (SELECT k % {_BUCKETS} AS bucket, count(*) AS n, list(k ORDER BY k) AS ks FROM ({keys.replace('orders_d', 'later')}) GROUP BY ALL) a"
            f" ON a.bucket = b.bucket, ({summary_sql(check_id, action_id).replace('orders_d', 'later')}) s WHERE a.ks IS DISTINCT FROM b.ks")
    return with_views(" UNION ALL ".join(parts), "orders_d", more=later)


@query("e12_changed_buckets", _bucket_sql())
def e12_changed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets, one of which is written anew: the recheck reads that one, names where targets
    changed, and gives the whole table's new target sets."""
    root = f"{fresh_store(spark).root}/orders"
    rows = views.frames(spark, sf_dir, only=["orders"])["orders"].withColumn("bucket", F.pmod("o_orderkey", F.lit(_BUCKETS)))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(root)
    read = filesets.parquet_files(spark, root)
    before = filesets.file_sets(REG, "orders", _ROW_POLICIES, filesets.list_files(spark, root), read)
    lost = F.when(F.expr(_LOST), None).otherwise(F.col("o_totalprice"))
    rewritten = rows.filter("bucket = 3").withColumn("o_totalprice", lost)
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    after = filesets.file_sets(REG, "orders", _ROW_POLICIES, filesets.list_files(spark, root), read, kept=before)
    # one file's targets may move to another file of its bucket; a bucket changed if its sums did
    bucketed = lambda sums: sums.withColumn("path", F.regexp_extract("path", r"bucket=(\d+)", 1)).groupBy("path", *filesets.POLICY).agg(
        F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in filesets.LANE_NAMES])
    changed = filesets.changed_files(bucketed(before[1]), bucketed(after[1]))
    totals = filesets.total_sets(REG, "orders", _ROW_POLICIES, after[1]).drop("table")
    # one row per policy
    return changed.join(F.broadcast(totals), list(filesets.POLICY)).select(
        *filesets.POLICY, F.col("path").cast("bigint").alias("bucket"), "n_before", "n_after", "target_count", "target_fingerprint")


@query("f10_details", with_corpus("""
SELECT proposal_id, 'citation_quality' AS name, 'unknown' AS detail, check_id AS id FROM g_judged WHERE NOT in_failed
UNION SELECT proposal_id, 'citation_quality', 'mismatched_contracts', check_id FROM g_judged WHERE in_failed AND mismatched
UNION SELECT proposal_id, unnest(['destructive_risk', 'allowlist_compliance']), 'action_ids', action_id FROM g_judged
  WHERE action_id = 'drop_table'
UNION SELECT proposal_id, 'check_policy', 'action_ids', action_id FROM g_judged WHERE refusal IS NOT NULL
UNION SELECT j.proposal_id, 'check_policy', 'omitted', r.check_id FROM (SELECT DISTINCT proposal_id, run_id FROM g_judged) j
  JOIN g_results r ON r.run_id = j.run_id AND r.status = 'fail'
  WHERE NOT EXISTS (SELECT 1 FROM g_judged c WHERE c.proposal_id = j.proposal_id AND c.check_id = r.check_id AND c.refusal IS NULL)
""", *governance.BASE, "g_results", more=governance.JUSTIFIED))
def f10_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores of a proposal object to."""
    judged = proposals.justify(corpus.actions(spark, sf_dir), corpus.results(spark, sf_dir), governance.REG, spark)
    return scoring.score_details(judged).select("proposal_id", "name", "detail", "id")


@query("g7_shadow", with_corpus("""
SELECT p.proposal_id, count(i.item_id) AS n_entries, count(i.reason) AS n_blocked,
  CASE WHEN r.incomplete OR count(i.reason) > 0 THEN 'Next: do not request a Human Decision.'
       WHEN count(i.item_id) > 0 THEN 'Next: the Shadow Review was recorded.' ELSE 'Next: no remediation is required.' END AS next
FROM g_proposals p JOIN g_runs r ON r.run_id = p.run_id LEFT JOIN g_items i ON i.proposal_id = p.proposal_id
GROUP BY p.proposal_id, r.incomplete""", *governance.BASE, more=governance.ITEMS))
def g7_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each shadow review, blocked ones included, and its last advice; ids and digests are the engine's own."""
    plans, items = governance.mixed_plans(spark, sf_dir)
    judged = compiler.evaluations(plans, compiler.evaluate_plans(plans, items, governance.REG))
    reviews = review.approval_reviews(plans, judged, review.review_items(items, governance.REG, spark))
    texts = review.shadow_reviews(reviews, plans, items, governance.REG)
    count = lambda pattern: F.regexp_count("body", F.lit(pattern)).cast("bigint")
    return by_id(texts, plans.select("plan_id", "proposal_id"), "plan_id").select(
        "proposal_id", count("(?m)^Table: warehouse").alias("n_entries"), count("(?m)^Risk: unavailable").alias("n_blocked"),
        F.regexp_extract("body", r"(?m)^(Next: [^.]*\.)", 1).alias("next"))
