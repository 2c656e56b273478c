import json

import pytest

from rowwarden import CheckPolicy, CheckSpec, ColumnContract, ContractError, Registry, TableContract
from rowwarden.functions.values import fill_value
from rowwarden.sources import warehouse

COLUMNS = [{"name": "id", "dtype": "int64"}, {"name": "v", "dtype": "utf8", "allowed_values": ["a", "b"]},
           {"name": "p", "dtype": "int64"}]
TABLE = {"table": "t", "columns": COLUMNS, "primary_key": ["id"], "foreign_keys": [["p", "t", "id"]]}


def check(**more):
    return {"check_id": "c", "table": "t", "column": "v", "dimension": "validity", **more}


def refused(message, *checks, tables=(TABLE,), **more):
    with pytest.raises(ContractError, match=message):
        Registry.from_document({"tables": list(tables), "checks": list(checks), **more})


def test_declaration_order_and_defaults():
    registry = warehouse.registry()
    assert (len(registry.contracts), len(registry.checks)) == (8, 23)
    assert registry.contract("warehouse.fact_orders") is registry.contract("fact_orders")
    assert registry.check("dim_customer.email.validity").contract_id == "warehouse.dim_customer"


def test_errors_name_file_and_field():
    refused(r"document: tables\.0\.columns\.0\.dtype: dtype", tables=[
        {**TABLE, "columns": [{"name": "id", "dtype": "int32"}]}])
    refused(r"tables\.0\.table: invalid identifier", tables=[{**TABLE, "table": "a b"}])
    refused(r"tables\.1\.table: table 't' is already registered", tables=[TABLE, {**TABLE, "schema_name": "x"}])
    refused(r"checks\.0\.table: unknown table", check(table="nope"))
    refused(r"checks\.1\.check_id: check_id 'c' is already registered", check(), check())
    refused(r"checks\.0\.policies\.0\.action_id: unknown action_id", check(policies=[{"action_id": "drop"}]))
    refused(r"tables\.0: must be a mapping", tables=["x"])
    refused("extra: unknown field", extra=1)


def test_rules_a_check_must_have():
    refused("must name a column", {"check_id": "c", "table": "t", "dimension": "completeness"})
    refused("no validity rule", check(column="p"))
    refused("needle", check(contains="100%"))
    refused("business_key", {"check_id": "c", "table": "t", "dimension": "uniqueness"})
    refused("not a contracted foreign key", check(dimension="referential_integrity"))
    refused("single-column primary key", check(), tables=[{**TABLE, "primary_key": ["id", "p"]}])
    drift = {"check_id": "c", "table": "t", "dimension": "schema_drift"}
    Registry.from_document({"tables": [{**TABLE, "primary_key": ["id", "p"]}], "checks": [drift]})


def test_policies_are_bound_when_registered():
    refused("not a validity check", check(dimension="completeness", policies=[{"action_id": "quarantine_invalids"}]))
    refused("missing param business_key", check(policies=[{"action_id": "dedupe_keep_min_pk"}]))
    refused("unexpected param sql", check(policies=[{"action_id": "quarantine_nulls", "parameters": {"sql": 1}}]))
    refused("is not allowed on t", check(policies=[{"action_id": "quarantine_nulls"}]),
            action_tables={"quarantine_nulls": ["other"]})
    refused("requires a utf8 fill_value", check(policies=[{"action_id": "null_fill", "parameters": {"fill_value": 3}}]))
    refused("'zz' is not a column", check(policies=[
        {"action_id": "dedupe_keep_min_pk", "parameters": {"business_key": ["zz"]}}]))
    orphan = check(column="p", dimension="referential_integrity", policies=[{"action_id": "quarantine_orphans"}])
    registry = Registry.from_document({"tables": [TABLE], "checks": [orphan]})
    assert registry.policy_params(registry.check("c"), "quarantine_orphans") == {
        "fk_column": "p", "ref_table": "t", "ref_column": "id", "pk_column": "id"}


def test_in_process_registration_rolls_back():
    registry = Registry()
    registry.register_contract(TableContract("t", (ColumnContract("id", "int64"),), ("id",)))
    bad = CheckSpec("c", "t", "completeness", column="id", policies=(CheckPolicy("dedupe_keep_min_pk"),))
    with pytest.raises(ContractError):
        registry.register_check(bad)
    assert not registry.checks


def test_files_are_all_or_nothing(tmp_path):
    yaml = pytest.importorskip("yaml")
    good, bad = tmp_path / "good.yaml", tmp_path / "bad.json"
    good.write_text(yaml.safe_dump({"tables": [TABLE], "checks": [check()]}))
    bad.write_text(json.dumps({"tables": [{**TABLE, "table": "u"}], "checks": [check(check_id="d", table="v")]}))
    registry = Registry.from_file(good)
    with pytest.raises(ContractError, match="bad.json: checks.0.table"):
        registry.load(bad)
    assert list(registry.contracts) == ["t"] and list(registry.checks) == ["c"]
    (tmp_path / "empty.yaml").write_text("")
    assert not Registry.from_file(tmp_path / "empty.yaml").contracts
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ContractError, match="must be a mapping"):
        Registry.from_file(tmp_path / "list.yaml")
    (tmp_path / "torn.yaml").write_text("a: [1")
    with pytest.raises(ContractError, match="torn.yaml"):
        Registry.from_file(tmp_path / "torn.yaml")


def test_fill_values():
    from datetime import date, datetime

    fits = lambda dtype, value: fill_value(ColumnContract("c", dtype), value)
    assert fits("float64", 1) == 1.0 and fits("date", "2024-02-29") == date(2024, 2, 29)
    assert fits("datetime", "2024-02-29T10:00:00") == datetime(2024, 2, 29, 10)
    for dtype, value in (("int64", True), ("int64", 1.5), ("float64", True), ("bool", 1), ("utf8", 1),
                         ("date", datetime(2024, 1, 1)), ("date", "2024-02-30"), ("datetime", "soon")):
        with pytest.raises(ContractError):
            fits(dtype, value)


def test_policy_fingerprint_follows_parents():
    base = warehouse.document()
    changed = warehouse.document()
    changed["tables"][1]["description"] = "reworded"  # dim_product
    one, two = Registry.from_document(base), Registry.from_document(changed)
    orphan = ("fact_order_items.product_sk.referential_integrity", "quarantine_orphans")
    nulls = ("fact_orders.total_amount.completeness", "quarantine_nulls")
    assert one.policy_fingerprint(*orphan) != two.policy_fingerprint(*orphan)
    assert one.policy_fingerprint(*nulls) == two.policy_fingerprint(*nulls)
