"""A generated warehouse with planted defects, at any scale.

Every value is a closed form of the row's id, so tables are generated in parallel and are the
same on every run. ``scale=1`` gives the published demonstration sizes and defect keys.
Ids of planted rows start behind the generated ones at larger scales.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.operators.conformance import FieldRule
from rowwarden.registry import Registry
from rowwarden.session import config_frame

# Vocabularies of the demonstration data.
COUNTRIES = ("US", "GB", "DE", "FR", "ES", "CA", "NL")
CATEGORIES = ("devices", "consumables", "apparel", "lab")
STATUSES = ("placed", "paid", "shipped", "cancelled", "returned")
CURRENCIES = ("USD", "EUR", "GBP")
AE_TERMS = ("AE-HEADACHE", "AE-NAUSEA", "AE-FATIGUE", "AE-RASH", "AE-COUGH")
VISIT_CODES = ("SCR", "W1", "W4", "W8", "EOT")
REGIONS = ("north", "south", "east", "west")
SEXES = ("M", "F", "U")
SEVERITIES = ("mild", "moderate", "severe")
VISIT_STATUSES = ("scheduled", "completed", "missed", "window_violation")

# Contracts (column:type), keys and references. ``shadow_segment`` of
# dim_customer is generated but not contracted: it is the planted drift.
TABLES = {
    "dim_customer": "customer_sk:int64 customer_nk:utf8 email:utf8 country:utf8 signup_date:date"
    " is_active:bool",
    "dim_product": "product_sk:int64 sku:utf8 category:utf8 unit_price:float64 active_flag:bool",
    "fact_orders": "order_id:int64 customer_sk:int64 order_ts:datetime status:utf8"
    " total_amount:float64 currency:utf8",
    "fact_order_items": "order_item_id:int64 order_id:int64 product_sk:int64 qty:int64"
    " unit_price:float64",
    "dim_site": "site_sk:int64 site_id:utf8 country:utf8 region:utf8",
    "dim_patient": "patient_sk:int64 subject_id:utf8 site_sk:int64 sex:utf8 birth_year:int64"
    " enrolled_on:date",
    "fact_visits": "visit_id:int64 patient_sk:int64 visit_code:utf8 window_start:date"
    " window_end:date visit_date:date status:utf8",
    "fact_adverse_events": "ae_id:int64 patient_sk:int64 term_code:utf8 severity:utf8"
    " onset_date:date related_flag:bool",
}
ALLOWED = {
    ("dim_product", "category"): CATEGORIES,
    ("fact_orders", "status"): STATUSES,
    ("fact_orders", "currency"): CURRENCIES,
    ("dim_patient", "sex"): SEXES,
    ("fact_visits", "status"): VISIT_STATUSES,
    ("fact_adverse_events", "severity"): SEVERITIES,
}
REFERENCES = {
    "fact_orders": [("customer_sk", "dim_customer", "customer_sk")],
    "fact_order_items": [("order_id", "fact_orders", "order_id"),
                         ("product_sk", "dim_product", "product_sk")],
    "dim_patient": [("site_sk", "dim_site", "site_sk")],
    "fact_visits": [("patient_sk", "dim_patient", "patient_sk")],
    "fact_adverse_events": [("patient_sk", "dim_patient", "patient_sk")],
}
# Table lineage beyond the contracted references.
PIPELINES = (
    ("stg_shop_orders", "fact_orders"),
    ("stg_shop_items", "fact_order_items"),
    ("stg_subjects", "dim_patient"),
)
# Which tables the restricted actions may touch.
ACTION_TABLES = {
    "null_fill": ["fact_orders", "fact_visits", "dim_patient"],
    "quarantine_orphans": ["fact_order_items", "fact_orders", "fact_visits",
                           "fact_adverse_events", "dim_patient"],
    "dedupe_keep_min_pk": ["fact_orders", "dim_patient", "dim_customer"],
}


def _check(name: str, dimension: str, action: str, *, column: str | None = None, given=None, **rule):
    table, _, tail = name.partition(".")
    policy = {"action_id": action, **({"parameters": given} if given else {})}
    return {"check_id": f"{name}.{dimension}", "table": table, "dimension": dimension,
            "column": column or tail, "policies": [policy], **rule}


def document() -> dict:
    """The demonstration registry: 8 tables, 23 checks, in fixed order."""
    order_key, subject = ["customer_sk", "order_ts"], ["subject_id"]
    checks = [
        _check("fact_orders.total_amount", "completeness", "quarantine_nulls"),
        _check("fact_orders.status", "validity", "quarantine_invalids"),
        _check("fact_orders.order_nk", "uniqueness", "dedupe_keep_min_pk", column="order_ts",
               given={"business_key": order_key}, business_key=order_key),
        _check("fact_order_items.product_sk", "referential_integrity", "quarantine_orphans"),
        _check("dim_customer.email", "validity", "quarantine_invalids", contains="@"),
        _check("dim_patient.sex", "completeness", "quarantine_nulls"),
        _check("dim_patient.subject_id", "uniqueness", "dedupe_keep_min_pk",
               given={"business_key": subject}, business_key=subject),
        _check("fact_visits.visit_date", "validity", "quarantine_invalids",
               window_start_column="window_start", window_end_column="window_end"),
        _check("fact_visits.patient_sk", "referential_integrity", "quarantine_orphans"),
        _check("fact_adverse_events.term_code", "completeness", "quarantine_nulls"),
        _check("fact_adverse_events.severity", "validity", "quarantine_invalids"),
        _check("fact_orders.customer_sk", "referential_integrity", "quarantine_orphans"),
        _check("dim_product.sku", "uniqueness", "no_op_alert", business_key=["sku"]),
        _check("dim_patient.site_sk", "referential_integrity", "quarantine_orphans"),
        _check("fact_adverse_events.patient_sk", "referential_integrity", "quarantine_orphans"),
    ]
    checks += [
        {"check_id": f"{table}.schema_drift", "table": table, "dimension": "schema_drift",
         "policies": [{"action_id": "schema_drift_ticket"}]}
        for table in TABLES
    ]
    tables = []
    for table, text in TABLES.items():
        columns = [dict(zip(("name", "dtype"), item.split(":"))) for item in text.split()]
        for column in columns:
            if (table, column["name"]) in ALLOWED:
                column["allowed_values"] = list(ALLOWED[table, column["name"]])
        tables.append({"table": table, "columns": columns, "primary_key": [columns[0]["name"]],
                       "foreign_keys": [list(key) for key in REFERENCES.get(table, [])]})
    return {"tables": tables, "checks": checks, "action_tables": ACTION_TABLES}


def registry() -> Registry:
    return Registry.from_document(document(), "warehouse")


def lineage_edges(spark: SparkSession) -> DataFrame:
    rows = [(s, t, "pipeline") for s, t in PIPELINES]
    # the order line to order and product references, and so on, in contract order
    rows += [(parent, table, "fk") for table, keys in REFERENCES.items() for _, parent, _ in keys]
    return config_frame(spark, rows, "source string, target string, kind string")


# Expected failures per check at any scale, one set of planted rows.
EXPECTED = {
    "fact_orders.total_amount.completeness": 5,
    "fact_orders.status.validity": 3,
    "fact_orders.order_nk.uniqueness": 2,
    "fact_order_items.product_sk.referential_integrity": 3,
    "dim_customer.email.validity": 2,
    "dim_customer.schema_drift": 1,
    "dim_patient.sex.completeness": 1,
    "dim_patient.subject_id.uniqueness": 2,
    "fact_visits.visit_date.validity": 4,
    "fact_visits.patient_sk.referential_integrity": 2,
    "fact_adverse_events.term_code.completeness": 3,
    "fact_adverse_events.severity.validity": 2,
}


def conformance_rules() -> dict[str, list[FieldRule]]:
    """Types from the contracts, plus the ranges of the typed layer."""
    ranges = {  # fixed values
        ("dim_product", "unit_price"): {"ge": 0.0},
        ("fact_orders", "total_amount"): {"ge": 0.0, "nullable": True},
        ("fact_order_items", "qty"): {"gt": 0},
        ("fact_order_items", "unit_price"): {"ge": 0.0},
        ("dim_patient", "sex"): {"nullable": True},
        ("dim_patient", "birth_year"): {"ge": 1920, "le": 2020},
        ("fact_visits", "visit_date"): {"nullable": True},
        ("fact_adverse_events", "term_code"): {"nullable": True},
    }
    # in the typed layer order status and severity carry no value list
    free = {("fact_orders", "status"), ("fact_adverse_events", "severity")}
    rules = {}
    for table, text in TABLES.items():
        rules[table] = [
            FieldRule(name, dtype, isin=None if (table, name) in free else ALLOWED.get((table, name)),
                      **ranges.get((table, name), {}))
            for name, dtype in (item.split(":") for item in text.split())
        ]
    return rules


# -- rows ---------------------------------------------------------------------------------


def _pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values) + 1).cast("int"))


def _code(prefix: str, number: Column, width: int) -> Column:
    # wider numbers keep all their digits
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(
        F.lpad(digits, width, "0")))


def _day(base: str, days: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int"))


def _hour(base: str, hours: Column, micros: bool = True) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(base + "+00:00").cast("timestamp")) + hours * 3_600_000_000)


def orders(ids: DataFrame, shift: int = 0) -> DataFrame:
    """Clean orders for a frame of ids, then the planted ones."""
    oid = F.col("id")
    clean = ids.select(
        oid.alias("order_id"), (1 + oid % 100).alias("customer_sk"),
        _hour("2025-03-01 00:00:00", oid).alias("order_ts"), _pick(STATUSES, oid).alias("status"),
        F.round(20.0 + (oid % 50) * 3.4, 2).alias("total_amount"),
        _pick(CURRENCIES, oid).alias("currency"))
    spark = ids.sparkSession
    planted = spark.range(9001, 9006).select("id", F.lit(0).alias("g")).unionByName(
        spark.range(9101, 9104).select("id", F.lit(1).alias("g"))).unionByName(
        spark.range(9201, 9203).select("id", F.lit(2).alias("g")))
    group = lambda *values: _choose(F.col("g"), *values)
    defects = planted.select(
        (oid + shift).alias("order_id"),
        group(1, 2, 7).cast("bigint").alias("customer_sk"),
        group(_hour("2025-06-01 00:00:00", oid - 9001), _hour("2025-06-02 00:00:00", oid - 9101),
              _hour("2025-06-03 12:00:00", oid * 0)).alias("order_ts"),
        group("placed", "SHIPPPED", "paid").alias("status"),
        group(None, 40.0, 55.0).cast("double").alias("total_amount"),
        F.lit("USD").alias("currency"))
    return clean.unionByName(defects)


def _choose(group: Column, *values) -> Column:
    chosen = F.lit(None)
    for position, value in enumerate(values):
        chosen = F.when(group == position, value).otherwise(chosen)
    return chosen


def _price(product: Column) -> Column:
    return F.round(5.0 + product * 1.25, 2)


def order_items(spark: SparkSession, n_orders: int, shift: int) -> DataFrame:
    """One to three lines per order; the line id is the closed-form running number of lines."""
    oid, before = F.col("id"), F.col("id") - 1
    lines = spark.range(1, n_orders + 1).select(
        oid.alias("order_id"),
        # lines of all earlier orders: one each, plus the sum of o % 3
        (before + 3 * F.floor(before / 3) + _choose(before % 3, 0, 1, 3)).alias("__before"),
        F.explode(F.sequence(F.lit(1), (1 + oid % 3).cast("int"))).alias("line"))
    item = F.col("__before") + F.col("line")
    clean = lines.select(
        item.cast("bigint").alias("order_item_id"), "order_id",
        (1 + item % 40).cast("bigint").alias("product_sk"), (1 + item % 4).cast("bigint").alias("qty"),
        _price(1 + item % 40).alias("unit_price"))
    of_nulls = spark.range(9001, 9006).select(
        (oid + 8000 + shift * 4).alias("order_item_id"), (oid + shift).alias("order_id"),
        F.lit(1).cast("bigint").alias("product_sk"), F.lit(1).cast("bigint").alias("qty"),
        F.lit(5.0).alias("unit_price"))
    orphans = spark.range(9301, 9304).select(
        (oid + shift * 4).alias("order_item_id"), (oid - 9291).alias("order_id"),
        F.lit(999001).cast("bigint").alias("product_sk"), F.lit(1).cast("bigint").alias("qty"),
        F.lit(9.99).alias("unit_price"))
    return clean.unionByName(of_nulls).unionByName(orphans)


def generate(spark: SparkSession, scale: int = 1) -> dict[str, DataFrame]:
    """All eight tables. Order and visit tables grow with ``scale``; dimensions keep their size,
    so every reference of a clean row resolves at any scale."""
    shift = 0 if scale == 1 else 1_000_000 * scale
    sk = F.col("id")
    n_orders, n_patients = 200 * scale, 80 * scale
    customers = spark.range(1, 121).select(
        sk.alias("customer_sk"), _code("CUST-", sk, 4).alias("customer_nk"),
        F.when(sk.isin(101, 102), F.concat(_code("c", sk, 3), F.lit(".invalid"))).otherwise(
            F.concat(_code("c", sk, 3), F.lit("@example.test"))).alias("email"),
        _pick(COUNTRIES, sk).alias("country"), _day("2025-01-01", sk).alias("signup_date"),
        (sk % 17 != 0).alias("is_active"), F.when(sk % 11 == 0, "beta").alias("shadow_segment"))
    products = spark.range(1, 41).select(
        sk.alias("product_sk"), _code("SKU-", sk, 4).alias("sku"), _pick(CATEGORIES, sk).alias("category"),
        _price(sk).alias("unit_price"), F.lit(True).alias("active_flag"))
    sites = spark.range(1, 21).select(
        sk.alias("site_sk"), _code("SITE-", sk, 2).alias("site_id"), _pick(COUNTRIES, sk).alias("country"),
        _pick(REGIONS, sk).alias("region"))
    patients = spark.range(1, n_patients + 1).select(
        sk.alias("patient_sk"), _code("SUBJ-", sk, 4).alias("subject_id"), (1 + sk % 20).alias("site_sk"),
        _pick(SEXES, sk).alias("sex"), (1960 + sk % 40).alias("birth_year"),
        _day("2024-09-01", sk % 3650).alias("enrolled_on"))
    planted = spark.range(501, 504).withColumn("g", sk - 501).select(
        (sk + shift).alias("patient_sk"),
        _choose(F.col("g"), _code("SUBJ-", sk + shift, 4), "SUBJ-DUPE", "SUBJ-DUPE").alias("subject_id"),
        _choose(F.col("g"), 1, 2, 2).cast("bigint").alias("site_sk"),
        _choose(F.col("g"), None, "F", "M").cast("string").alias("sex"),
        _choose(F.col("g"), 1980, 1975, 1976).cast("bigint").alias("birth_year"),
        _day("2024-10-01", F.col("g")).alias("enrolled_on"))
    enrolled = _day("2024-09-01", F.col("patient_sk") % 3650)
    visit = spark.range(0, n_patients * 5).select(
        (sk + 1).alias("visit_id"), (F.floor(sk / 5) + 1).cast("bigint").alias("patient_sk"),
        (sk % 5).alias("v")).select(
        "visit_id", "patient_sk", _pick(VISIT_CODES, F.col("v")).alias("visit_code"),
        F.date_add(enrolled, (7 * F.col("v")).cast("int")).alias("window_start"),
    )
    visits = visit.select(
        "*", F.date_add("window_start", 5).alias("window_end"),
        F.date_add("window_start", 1).alias("visit_date"), F.lit("completed").alias("status"))
    week = (F.lit("2025-01-01").cast("date").alias("window_start"),
            F.lit("2025-01-07").cast("date").alias("window_end"))
    outside = spark.range(9401, 9405).select(
        (sk + shift * 4).alias("visit_id"), F.lit(1).cast("bigint").alias("patient_sk"),
        F.lit("W99").alias("visit_code"), *week,
        F.when((sk - 9401) % 2 == 0, F.lit("2025-03-01")).otherwise("2024-12-01").cast("date").alias("visit_date"),
        F.lit("completed").alias("status"))
    lost = spark.range(9501, 9503).select(
        (sk + shift * 4).alias("visit_id"), F.lit(999501 + 100 * shift).cast("bigint").alias("patient_sk"),
        F.lit("SCR").alias("visit_code"), *week, F.lit("2025-01-02").cast("date").alias("visit_date"),
        F.lit("scheduled").alias("status"))
    adverse = spark.range(1, 31).select(
        sk.alias("ae_id"), sk.alias("patient_sk"), _pick(AE_TERMS, sk).alias("term_code"),
        _pick(SEVERITIES, sk).alias("severity"), _day("2025-02-01", sk).alias("onset_date"),
        (sk % 4 == 0).alias("related_flag"))
    no_term = spark.range(9601, 9604).select(
        sk.alias("ae_id"), F.lit(3).cast("bigint").alias("patient_sk"),
        F.lit(None).cast("string").alias("term_code"), F.lit("mild").alias("severity"),
        _day("2025-04-01", sk - 9601).alias("onset_date"), F.lit(False).alias("related_flag"))
    lethal = spark.range(9701, 9703).select(
        sk.alias("ae_id"), F.lit(4).cast("bigint").alias("patient_sk"),
        F.lit("AE-HEADACHE").alias("term_code"), F.lit("lethal").alias("severity"),
        _day("2025-04-10", sk - 9701).alias("onset_date"), F.lit(True).alias("related_flag"))
    return {
        "dim_customer": customers,
        "dim_product": products,
        "fact_orders": orders(spark.range(1, n_orders + 1), shift),
        "fact_order_items": order_items(spark, n_orders, shift),
        "dim_site": sites,
        "dim_patient": patients.unionByName(planted),
        "fact_visits": visits.unionByName(outside).unionByName(lost),
        "fact_adverse_events": adverse.unionByName(no_term).unionByName(lethal),
    }


def external_invoice(spark: SparkSession) -> DataFrame:
    """Four invoices, two without an amount."""
    number = F.col("id")
    return spark.range(101, 105).select(
        number.alias("invoice_id"),
        F.when(number % 2 == 1, (10.0 + (number - 101) * 5.0)).alias("amount"))


def invoice_registry() -> Registry:
    return Registry.from_document({
        "tables": [{"table": "ext_invoice", "primary_key": ["invoice_id"], "columns": [
            {"name": "invoice_id", "dtype": "int64"}, {"name": "amount", "dtype": "float64"}]}],
        "checks": [_check("ext_invoice.amount", "completeness", "quarantine_nulls")],
    }, "invoice")


def write_warehouse(frames: Mapping[str, DataFrame], root: str) -> None:
    """Store the generated tables as Parquet, one folder per table."""
    for table, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{root}/{table}.parquet")
