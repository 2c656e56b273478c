import pytest
from pyspark.sql import functions as F

from rowwarden import Registry
from rowwarden.operators import checks, conformance, remediation, suite
from rowwarden.sources import tables, warehouse

# Primary keys each check must find and each action must target.
GOLDEN = {
    "fact_orders.total_amount.completeness": (range(9001, 9006), None),
    "fact_orders.status.validity": (range(9101, 9104), None),
    "fact_orders.order_nk.uniqueness": ([9201, 9202], [9202]),
    "fact_order_items.product_sk.referential_integrity": (range(9301, 9304), None),
    "dim_customer.email.validity": ([101, 102], None),
    "dim_patient.sex.completeness": ([501], None),
    "dim_patient.subject_id.uniqueness": ([502, 503], [503]),
    "fact_visits.visit_date.validity": (range(9401, 9405), None),
    "fact_visits.patient_sk.referential_integrity": (range(9501, 9503), None),
    "fact_adverse_events.term_code.completeness": (range(9601, 9604), None),
    "fact_adverse_events.severity.validity": ([9701, 9702], None),
}
REG = warehouse.registry()


def keys(frame, name):
    return sorted(row[0] for row in frame.select(name).collect())


@pytest.mark.parametrize("check_id", GOLDEN)
def test_golden_keys(warehouse, check_id):
    found, targeted = GOLDEN[check_id]
    spec = REG.check(check_id)
    pk = REG.contract(spec.table).single_key
    assert keys(checks.failing_rows(REG, check_id, warehouse), pk) == list(found)
    action = spec.policies[0].action_id
    targets = remediation.target_rows(REG, check_id, action, warehouse)
    assert keys(targets, pk) == list(targeted if targeted is not None else found)
    sample = checks.sample_rows(REG, check_id, warehouse)
    if spec.business_key:
        assert [row.n for row in sample.collect()] == [2]
    else:
        assert [row[pk] for row in sample.collect()] == list(found)


def test_golden_suite(spark, warehouse):
    results = suite.run_suite(REG, warehouse, spark).orderBy("ordinal").collect()
    assert [row.check_id for row in results] == list(REG.checks)
    failed = {row.check_id: row.n_failed for row in results if row.status == "fail"}
    from rowwarden.sources.warehouse import EXPECTED

    assert failed == EXPECTED and not [row for row in results if row.status == "error"]
    by_id = {row.check_id: row for row in results}
    assert by_id["fact_orders.total_amount.completeness"].message == "5/210 null total_amount on fact_orders"
    assert by_id["dim_customer.email.validity"].message == "2 emails missing @"
    assert by_id["fact_visits.visit_date.validity"].message == "4 visits outside window"
    assert by_id["fact_orders.order_nk.uniqueness"].message == "2 rows share (customer_sk, order_ts)"
    drift = by_id["dim_customer.schema_drift"]
    assert (drift.n_total, drift.message) == (7, "drift on dim_customer: extra=['shadow_segment'] missing=[]")
    assert by_id["dim_site.schema_drift"].message == "dim_site matches contract (4 columns)"
    assert "sample_failures" not in results[0].__fields__


def test_suite_without_broadcasts_is_the_same(spark, warehouse, no_broadcast):
    results = suite.run_suite(REG, warehouse, spark)
    from rowwarden.sources.warehouse import EXPECTED

    assert {r.check_id: r.n_failed for r in results.filter("status = 'fail'").collect()} == EXPECTED


def test_structural_errors(spark, warehouse):
    frames = dict(warehouse)
    frames["fact_orders"] = frames["fact_orders"].drop("total_amount", "order_id")
    del frames["dim_product"]
    results = {r.check_id: r for r in suite.run_suite(REG, frames, spark).collect()}
    errors = {k: v.message for k, v in results.items() if v.status == "error"}
    assert errors == {
        "fact_orders.total_amount.completeness":
            "cannot evaluate fact_orders.total_amount.completeness: missing column total_amount on fact_orders",
        "fact_orders.customer_sk.referential_integrity":
            "cannot evaluate fact_orders.customer_sk.referential_integrity: missing column order_id on fact_orders",
        "fact_order_items.product_sk.referential_integrity":
            "cannot evaluate fact_order_items.product_sk.referential_integrity: missing table dim_product",
        "dim_product.sku.uniqueness": "cannot evaluate dim_product.sku.uniqueness: missing table dim_product",
    }
    assert all((results[k].n_failed, results[k].n_total) == (0, 0) for k in errors)
    assert results["dim_product.schema_drift"].message == "drift on dim_product: missing table dim_product"
    assert results["fact_orders.status.validity"].n_failed == 3
    drift = checks.failing_rows(REG, "fact_orders.schema_drift", frames)
    assert sorted(map(tuple, drift.collect())) == [("missing", "order_id"), ("missing", "total_amount")]


def test_nulls_and_special_values(spark):
    registry = Registry.from_document({
        "tables": [{"table": "t", "primary_key": ["id"], "columns": [
            {"name": "id", "dtype": "int64"}, {"name": "s", "dtype": "utf8", "allowed_values": ["a"]},
            {"name": "x", "dtype": "float64"}, {"name": "lo", "dtype": "int64"}, {"name": "hi", "dtype": "int64"},
            {"name": "v", "dtype": "int64"}]}],
        "checks": [
            {"check_id": "filled", "table": "t", "column": "x", "dimension": "completeness"},
            {"check_id": "text", "table": "t", "column": "s", "dimension": "completeness"},
            {"check_id": "allowed", "table": "t", "column": "s", "dimension": "validity"},
            {"check_id": "literal", "table": "t", "column": "s", "dimension": "validity", "contains": "A."},
            {"check_id": "window", "table": "t", "column": "v", "dimension": "validity",
             "window_start_column": "lo", "window_end_column": "hi"}]})
    rows = spark.createDataFrame(
        [(1, "a", float("nan"), 1, 5, 5), (2, "", None, 1, 5, 6), (3, None, 1.0, None, 5, 0),
         (4, "A.b", 1.0, None, 5, 9), (5, "Axb", 1.0, 3, None, 2), (6, "a", 1.0, 3, None, 9),
         (7, "a", 1.0, 1, 5, None)], "id long, s string, x double, lo long, hi long, v long")
    failing = {c: keys(checks.failing_rows(registry, c, {"t": rows}), "id") for c in registry.checks}
    assert failing == {"filled": [2], "text": [3], "allowed": [2, 4, 5], "literal": [1, 2, 3, 5, 6, 7],
                       "window": [2, 4, 5]}
    counted = {r.check_id: r.n_failed for r in suite.run_suite(registry, {"t": rows}, spark).collect()}
    assert counted == {c: len(v) for c, v in failing.items()}
    empty = {r.check_id: (r.status, r.n_total) for r in suite.run_suite(
        registry, {"t": rows.filter("false")}, spark).collect()}
    assert set(empty.values()) == {("pass", 0)}


def test_sample_limits(warehouse):
    for limit in (0, 101):
        with pytest.raises(ValueError):
            checks.sample_rows(REG, "dim_patient.sex.completeness", warehouse, limit)
    with pytest.raises(KeyError):
        checks.sample_rows(REG, "unknown", warehouse)
    names = checks.sample_rows(REG, "dim_customer.schema_drift", warehouse, 3).collect()
    assert [row[0] for row in names] == ["customer_sk", "customer_nk", "email"]


def test_samples_are_bounded_and_textual(spark, warehouse):
    import json

    samples = suite.failure_samples(REG, warehouse, ["fact_visits.visit_date.validity"], limit=2).collect()
    assert [r.row_key for r in samples] == ["9401", "9402"]
    assert json.loads(samples[0].sample)["visit_date"] == "2025-03-01"


def test_sources(spark, warehouse, tmp_path):
    assert set(warehouse) == set(REG.contracts)
    found = tables.load_frames(spark, REG, tables.parquet_reader(str(tmp_path)))
    assert found == {}
    (tmp_path / "dim_site.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # anything but an absent table propagates
        tables.load_frames(spark, REG, tables.parquet_reader(str(tmp_path)))["dim_site"].collect()
    seen = tables.observed_columns(spark, warehouse).filter("table = 'dim_customer'").orderBy("position")
    assert [r.column for r in seen.collect()][-1] == "shadow_segment"
    schema = tables.observed_schema(spark, REG, warehouse, "warehouse.fact_orders")
    assert {r.column: r.type for r in schema.collect()}["total_amount"] == "double"
    with pytest.raises(KeyError):
        tables.observed_schema(spark, REG, warehouse, "other")
    warehouse["dim_site"].createOrReplaceTempView("dim_site")
    views = tables.load_frames(spark, REG, lambda session, table: session.table(table))
    assert set(views) == {"dim_site"}


def test_conformance(spark, warehouse):
    rules = warehouse_rules()
    results = conformance.conformance_of(warehouse, rules)
    assert {(r.table, r.column, r.rule): r.n_failed for r in results.filter("n_failed > 0").collect()} == {}
    broken = {"dim_patient": warehouse["dim_patient"].withColumn(
        "birth_year", F.when(F.col("patient_sk") < 3, 1900).when(F.col("patient_sk") == 3, None).otherwise(
            F.col("birth_year"))).withColumn("enrolled_on", F.concat(F.col("enrolled_on").cast("string"),
                                             F.when(F.col("patient_sk") == 5, "x").otherwise("")))}
    found = conformance.conformance_of(broken, {"dim_patient": rules["dim_patient"]})
    assert {(r.column, r.rule): r.n_failed for r in found.filter("n_failed > 0").collect()} == {
        ("birth_year", "ge"): 2, ("birth_year", "not_null"): 1, ("enrolled_on", "coercible"): 1}


def warehouse_rules():
    from rowwarden.sources.warehouse import conformance_rules

    return conformance_rules()


def test_null_fill_makes_a_new_table(spark, warehouse):
    registry = Registry.from_document({
        "tables": [t for t in warehouse_document()["tables"] if t["table"] in ("fact_orders", "dim_customer")],
        "checks": [{"check_id": "c", "table": "fact_orders", "column": "total_amount", "dimension": "completeness",
                    "policies": [{"action_id": "null_fill", "parameters": {"fill_value": 7}}]}]})
    filled = remediation.filled_rows(registry, "c", warehouse)
    assert filled.filter("total_amount = 7.0").count() == 5 and filled.filter("total_amount is null").isEmpty()
    assert warehouse["fact_orders"].filter("total_amount is null").count() == 5
    assert remediation.quarantine_rows(registry, "c", "null_fill", warehouse, "r") is None


def warehouse_document():
    from rowwarden.sources.warehouse import document

    return document()


def test_lineage_neighbours(spark):
    from rowwarden.operators import lineage
    from rowwarden.sources.warehouse import lineage_edges

    near = lineage.neighbours(lineage_edges(spark), "warehouse.dim_patient").collect()
    assert sorted((r.direction, r.neighbour) for r in near) == [
        ("downstream", "fact_adverse_events"), ("downstream", "fact_visits"),
        ("upstream", "dim_site"), ("upstream", "stg_subjects")]
    assert lineage.foreign_key_edges(REG, spark).count() == 6
