"""The text of shadow reviews, whole."""

from rowwarden.plans import review
from rowwarden.workload import views

REG = views.registry()
ITEM = "struct<action_id:string,table:string,evidence_check_ids:array<string>,target_count:bigint,reversible:boolean>"
AUDIT = ["Audit details:", "Plan id: {0}", "Plan fingerprint: pf", "Review fingerprint: rf", "Quality run: r",
         "Evaluation id: e", "Evaluation fingerprint: ef"]


def texts(spark, plans, items):
    reviews = spark.createDataFrame(
        [(p, "r", "pf", "rf", "e", "ef", passed, shown, 24.0) for p, passed, shown, _ in plans],
        "plan_id string, run_id string, plan_fingerprint string, review_fingerprint string, evaluation_id string,"
        f" evaluation_fingerprint string, evaluation_passed boolean, items array<{ITEM}>, ttl_hours double")
    heads = spark.createDataFrame([(p, reasons) for p, _, _, reasons in plans], "plan_id string, blocked_reasons array<string>")
    rows = spark.createDataFrame(
        items, "plan_id string, item_id string, ordinal int, kind string, evidence array<struct<check_id:string,contract_id:string>>")
    return {row["plan_id"]: row["body"].split("\n") for row in review.shadow_reviews(reviews, heads, rows, REG).collect()}


def test_shadow_reviews(spark):
    check = "orders.o_totalprice.completeness"
    shown = [("quarantine_nulls", "orders", [check], 7, True)]
    blocked = ("blocked", "x", 1, "non_executable", [("pages.url_n.validity", "k"), (check, "k")])
    found = texts(spark, [("good", True, shown, []), ("blocked", False, [], ["no", "never"]), ("empty", True, [], [])],
                  [blocked, ("good", "y", 0, "executable", [(check, "k")])])
    expiry = "Expiry guidance: " + review.expiry_guidance(24)
    audit = lambda plan: [line.format(plan) for line in AUDIT]
    assert found["good"] == [
        "Shadow Review", "Table: warehouse.orders", f"Failed checks: {check}", "Proposed effect: " + review.EFFECTS["quarantine_nulls"],
        "Exact target count: 7", "Risk: medium", "Reversibility: reversible", expiry, review.NEXT_RECORDED, *audit("good")]
    assert found["blocked"] == [
        "Shadow Review", "Table: warehouse.orders, warehouse.pages", f"Failed checks: pages.url_n.validity, {check}",
        *[f"{name}: unavailable (blocked)" for name in ("Proposed effect", "Exact target count", "Risk", "Reversibility")],
        "Blocked: no; never", expiry, review.NEXT_BLOCKED, *audit("blocked")]
    assert found["empty"] == [
        "Shadow Review", "Table: none", "Failed checks: none", "Proposed effect: none", "Exact target count: 0", "Risk: none",
        "Reversibility: not applicable", expiry, review.NEXT_NOTHING, *audit("empty")]
