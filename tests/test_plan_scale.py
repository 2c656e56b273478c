"""What many plans cost: no broadcast that grows with them, work for every core, target rows written once."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from rowwarden.operators.joins import by_id
from rowwarden.plans import apply, compiler
from rowwarden.session import config_frame, spread, stored
from rowwarden.sources import warehouse
from rowwarden.sources.sinks import LOG_FIELDS, Store

REG = warehouse.invoice_registry()
NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
CHECK = "ext_invoice.amount.completeness"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def made_items(spark, plans):
    rows = [(f"p{n}", "r", n, k, f"candidate-{k}", "executable" if k else "non_executable", "quarantine_nulls", "ext_invoice", "{}",
             None if k else ("no target", "refused")[n % 2], 2, "f", "y") for n in range(plans) for k in range(3)]
    return config_frame(spark, rows, "plan_id string, run_id string, proposal_id bigint, ordinal bigint, item_id string, kind string,"
                        " action_id string, table string, params string, reason string, target_count bigint,"
                        " target_fingerprint string, policy_fingerprint string").withColumn(
        "evidence", F.array(F.struct(F.lit(CHECK).alias("check_id"), F.lit("c").alias("contract_id"))))


def test_plan_artifacts_are_never_broadcast(spark):
    left, right = (stored(spark.range(50).select(F.col("id").alias("plan_id")), "ids") for _ in range(2))
    joined = by_id(left, right, "plan_id", "left")
    assert "SortMergeJoin" in plan_of(joined) and "Broadcast" not in plan_of(joined)
    items = stored(made_items(spark, 40), "items")
    heads = items.select("plan_id", "run_id", "proposal_id").distinct()
    results = config_frame(spark, [("r", 0, "c", "pass")], "run_id string, ordinal bigint, check_id string, status string")
    plans = stored(compiler.roll_up_plans(heads, items, results, items, "env"), "plans")
    for frame in (compiler.item_totals(items), compiler.evaluate_plans(plans, items, REG)):
        assert "Broadcast" not in plan_of(frame)


def test_item_digests_are_hashed_and_reasons_kept(spark):
    items = stored(made_items(spark, 40), "items")
    assert not any(word in plan_of(compiler.item_digests(items)) for word in ("ObjectHashAggregate", "SortAggregate"))
    rows = {row.plan_id: row for row in compiler.item_totals(items).collect()}
    assert len(rows) == 40 and {(r.n_items, r.n_executable, r.target_count) for r in rows.values()} == {(3, 2, 6)}
    assert rows["p0"].reasons == ["no target"] and rows["p1"].reasons == ["refused"]
    clean = compiler.item_totals(items.filter("kind = 'executable'")).head()
    assert clean.reasons == [] and clean.n_items == 2


def test_small_stored_tables_keep_every_core_busy(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = stored(spread(spark.range(5000).select((F.col("id") % 500).alias("plan_id")).distinct(), "plan_id"), "few")
    assert rows.select(F.input_file_name().alias("f")).distinct().count() == 2 * cores
    assert rows.count() == 500 and rows.rdd.getNumPartitions() >= cores


def test_targets_are_written_once_for_many_plans(spark, tmp_path):
    store, frames = Store(spark, str(tmp_path / "store")), {"ext_invoice": stored(warehouse.external_invoice(spark), "invoices")}
    many = 50
    items = config_frame(spark, [(CHECK, "quarantine_nulls", f"a{n}", "candidate-0") for n in range(many)],
                         "check_id string, action_id string, admission_id string, item_id string")
    written = apply._staged(items, REG, frames, store, "apply-1", "one", lambda: NOW).collect()
    assert len(written) == many and {w.written for w in written} == {2}
    assert store.staged_sets("one").count() == 2  # the targets, not targets times plans
    assert store.staged_copies("one").count() == 2 * many and store.quarantine().isEmpty()
    entry = config_frame(spark, [("a7", "one")], "admission_id string, attempt string")
    store.append_log(config_frame(spark, [], LOG_FIELDS).unionByName(entry, allowMissingColumns=True))
    assert [(r.admission_id, r.item_id, r.run_id) for r in store.quarantine().collect()] == [("a7", "candidate-0", "apply-1")] * 2
    store.stage_copies(store.quarantine().drop("quarantined_at"), "one", NOW)  # copies of an item's own stand beside shared ones
    found = store.copies_by_item(F.count(F.lit(1)).alias("n"), F.min("pk_json").alias("first")).collect()
    assert [(r.admission_id, r.n, r.first) for r in found] == [("a7", 2, '{"invoice_id":102}')] * 2
