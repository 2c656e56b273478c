"""Contracts and frames over the given tables.

The given tables are clean, so each frame plants defects by a rule on the row's own key: the
rule changes a value of some rows and keeps every row. ``SQL`` states the same views for the
reference database, so that both sides check the same data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.registry import Registry
from rowwarden.sources.tables import load_frames

# Column expressions are valid in both engines.
ORDERS_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END",
    "o_orderdate": "o_orderdate",
    "o_orderpriority": "o_orderpriority",
    # an orphaned, a nullable and a both-way reference, and bounds with gaps
    "cust_ref": "CASE WHEN o_orderkey % 89 = 0 THEN o_custkey + 1000000 ELSE o_custkey END",
    "cust_nk": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END",
    "status_nk": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END",
    "valid_from": "CAST(TIMESTAMP_NTZ '1996-01-01 00:00:00' AS TIMESTAMP_NTZ)",
    "valid_to": "CAST(TIMESTAMP_NTZ '2000-12-31 00:00:00' AS TIMESTAMP_NTZ)",
    "open_from": "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL"
    " ELSE CAST(TIMESTAMP_NTZ '1996-01-01 00:00:00' AS TIMESTAMP_NTZ) END",
    "open_to": "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL"
    " ELSE CAST(TIMESTAMP_NTZ '2000-12-31 00:00:00' AS TIMESTAMP_NTZ) END",
}
PAGES_COLUMNS = {
    "page_id": "page_id",
    "url": "url",
    "url_n": "CASE WHEN url LIKE '%.org%' THEN NULL ELSE url END",
    "html": "html",
}


def _select(table: str, columns: dict[str, str]) -> str:
    body = ", ".join(f"{rule} AS {name}" for name, rule in columns.items())
    return f"SELECT {body} FROM {table}".replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace(
        "AS TIMESTAMP_NTZ", "AS TIMESTAMP"
    )


SQL = {"orders_d": _select("orders", ORDERS_COLUMNS), "pages_d": _select("pages", PAGES_COLUMNS)}


def with_views(sql: str, *names: str, more: str = "") -> str:
    """Prefix a query with the named views as common table expressions."""
    parts = [f"{name} AS ({SQL[name]})" for name in names] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _columns(text: str) -> list[dict]:
    return [dict(zip(("name", "dtype"), item.split(":"))) for item in text.split()]


DOCUMENT = {
    "action_tables": {
        "dedupe_keep_min_pk": ["orders", "documents", "pages"],
        "quarantine_orphans": ["orders", "events", "documents", "customer", "nation"],
        "null_fill": ["orders"],
    },
    "tables": [
        {"table": "region", "primary_key": ["r_regionkey"],
         "columns": _columns("r_regionkey:int64 r_name:utf8")},
        {"table": "nation", "primary_key": ["n_nationkey"],
         "columns": _columns("n_nationkey:int64 n_name:utf8 n_regionkey:int64"),
         "foreign_keys": [["n_regionkey", "region", "r_regionkey"]]},
        {"table": "customer", "primary_key": ["c_custkey"],
         "columns": _columns("c_custkey:int64 c_name:utf8 c_nationkey:int64 c_acctbal:float64"
                             " c_mktsegment:utf8"),
         "foreign_keys": [["c_nationkey", "nation", "n_nationkey"]]},
        {"table": "orders", "primary_key": ["o_orderkey"],
         "columns": [
             {**item, "allowed_values": ["O", "F"]}
             if item["name"] in ("o_orderstatus", "status_nk") else item
             for item in _columns(
                 "o_orderkey:int64 o_custkey:int64 o_orderstatus:utf8 o_totalprice:float64"
                 " o_orderdate:datetime o_orderpriority:utf8 cust_ref:int64 cust_nk:int64"
                 " status_nk:utf8 valid_from:datetime valid_to:datetime open_from:datetime"
                 " open_to:datetime")],
         "foreign_keys": [["cust_ref", "customer", "c_custkey"],
                          ["o_custkey", "customer", "c_custkey"],
                          ["cust_nk", "customer", "c_custkey"]]},
        # two key columns that do not identify a row, so only its schema can be checked; the
        # contract names a column the table lacks and omits one it has
        {"table": "lineitem", "primary_key": ["l_orderkey", "l_linenumber"],
         "columns": _columns("l_orderkey:int64 l_partkey:int64 l_suppkey:int64 l_linenumber:int64"
                             " l_quantity:float64 l_extendedprice:float64 l_discount:float64"
                             " l_returnflag:utf8 l_linestatus:utf8 l_shipdate:datetime"
                             " l_comment:utf8")},
        {"table": "events", "primary_key": ["event_id"],
         "columns": [
             {**item, "allowed_values": ["view", "click", "purchase", "signup"]}
             if item["name"] == "event_type" else item
             for item in _columns("event_id:int64 ts:datetime user_id:int64 event_type:utf8"
                                  " value:float64 props:utf8")],
         "foreign_keys": [["user_id", "customer", "c_custkey"]]},
        {"table": "documents", "primary_key": ["doc_id"],
         "columns": _columns("doc_id:int64 text:utf8 lang:utf8 source:utf8 n_chars:int64"),
         "foreign_keys": [["doc_id", "labels", "doc_id"]]},
        {"table": "labels", "primary_key": ["doc_id"],
         "columns": _columns("doc_id:int64 quality:int64 toxic:int64")},
        {"table": "pages", "primary_key": ["page_id"],
         "columns": _columns("page_id:int64 url:utf8 url_n:utf8 html:utf8")},
    ],
    "checks": [
        {"check_id": "orders.o_totalprice.completeness", "table": "orders",
         "column": "o_totalprice", "dimension": "completeness",
         "description": "every order has a price",
         "policies": [{"action_id": "quarantine_nulls"},
                      {"action_id": "null_fill", "parameters": {"fill_value": 0.0}}]},
        {"check_id": "orders.o_orderstatus.validity", "table": "orders",
         "column": "o_orderstatus", "dimension": "validity", "description": "status is O or F",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "orders.status_nk.validity", "table": "orders", "column": "status_nk",
         "dimension": "validity", "description": "status is O, F or unknown",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "orders.o_orderdate.validity", "table": "orders", "column": "o_orderdate",
         "dimension": "validity", "window_start_column": "valid_from",
         "window_end_column": "valid_to", "description": "ordered inside the fixed window",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "orders.o_orderdate.open_window", "table": "orders", "column": "o_orderdate",
         "dimension": "validity", "window_start_column": "open_from",
         "window_end_column": "open_to", "description": "ordered inside the half-open window",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "orders.order_nk.uniqueness", "table": "orders", "column": "o_orderdate",
         "dimension": "uniqueness", "business_key": ["o_custkey", "o_orderdate"],
         "description": "one order per customer and day",
         "policies": [{"action_id": "dedupe_keep_min_pk",
                       "parameters": {"business_key": ["o_custkey", "o_orderdate"]}}]},
        {"check_id": "orders.null_nk.uniqueness", "table": "orders", "column": "o_orderdate",
         "dimension": "uniqueness", "business_key": ["cust_nk", "o_orderdate"],
         "description": "one order per known customer and day",
         "policies": [{"action_id": "dedupe_keep_min_pk",
                       "parameters": {"business_key": ["cust_nk", "o_orderdate"]}}]},
        {"check_id": "orders.cust_ref.referential_integrity", "table": "orders",
         "column": "cust_ref", "dimension": "referential_integrity",
         "description": "the customer exists", "policies": [{"action_id": "quarantine_orphans"}]},
        {"check_id": "orders.cust_nk.referential_integrity", "table": "orders",
         "column": "cust_nk", "dimension": "referential_integrity",
         "description": "a known customer exists", "policies": [{"action_id": "quarantine_orphans"}]},
        {"check_id": "events.event_type.validity", "table": "events", "column": "event_type",
         "dimension": "validity", "description": "known event type",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "events.user_id.referential_integrity", "table": "events",
         "column": "user_id", "dimension": "referential_integrity",
         "description": "the user is a customer", "policies": [{"action_id": "quarantine_orphans"}]},
        {"check_id": "pages.url.validity", "table": "pages", "column": "url",
         "dimension": "validity", "contains": "https://", "description": "the address is secure",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "pages.url_n.validity", "table": "pages", "column": "url_n",
         "dimension": "validity", "contains": "https://", "description": "a secure address is present",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "pages.url.uniqueness", "table": "pages", "column": "url",
         "dimension": "uniqueness", "business_key": ["url"], "description": "one page per address",
         "policies": [{"action_id": "no_op_alert"}]},
        {"check_id": "documents.doc_id.referential_integrity", "table": "documents",
         "column": "doc_id", "dimension": "referential_integrity",
         "description": "the document is labelled", "policies": [{"action_id": "quarantine_orphans"}]},
        {"check_id": "documents.text.uniqueness", "table": "documents", "column": "text",
         "dimension": "uniqueness", "business_key": ["text"], "description": "texts are distinct",
         "policies": [{"action_id": "dedupe_keep_min_pk", "parameters": {"business_key": ["text"]}}]},
        {"check_id": "customer.c_nationkey.referential_integrity", "table": "customer",
         "column": "c_nationkey", "dimension": "referential_integrity",
         "description": "the nation exists", "policies": [{"action_id": "quarantine_orphans"}]},
        {"check_id": "nation.n_regionkey.referential_integrity", "table": "nation",
         "column": "n_regionkey", "dimension": "referential_integrity",
         "description": "the region exists", "policies": [{"action_id": "quarantine_orphans"}]},
    ]
    + [
        {"check_id": f"{table}.schema_drift", "table": table, "dimension": "schema_drift",
         "description": "columns match the contract",
         "policies": [{"action_id": "schema_drift_ticket"}]}
        for table in ("region", "nation", "customer", "orders", "lineitem", "events", "documents",
                      "labels", "pages")
    ],
}

# A second registry whose structure does not fit the data: an absent table, an absent column.
BROKEN = {
    "tables": DOCUMENT["tables"] + [
        {"table": "returns", "primary_key": ["r_id"], "columns": _columns("r_id:int64 r_order:int64"),
         "foreign_keys": [["r_order", "orders", "o_orderkey"]]},
        {"table": "supplier", "primary_key": ["s_suppkey"],
         "columns": _columns("s_suppkey:int64 s_phone:utf8 s_return:int64"),
         "foreign_keys": [["s_suppkey", "returns", "r_id"]]},
    ],
    "checks": [
        DOCUMENT["checks"][0],
        {"check_id": "returns.r_order.referential_integrity", "table": "returns",
         "column": "r_order", "dimension": "referential_integrity"},
        {"check_id": "supplier.s_phone.completeness", "table": "supplier", "column": "s_phone",
         "dimension": "completeness"},
        {"check_id": "supplier.s_suppkey.referential_integrity", "table": "supplier",
         "column": "s_suppkey", "dimension": "referential_integrity"},
        {"check_id": "returns.schema_drift", "table": "returns", "dimension": "schema_drift"},
        {"check_id": "supplier.schema_drift", "table": "supplier", "dimension": "schema_drift"},
    ],
}


@lru_cache(maxsize=None)
def registry() -> Registry:
    return Registry.from_document(DOCUMENT, "workload")


@lru_cache(maxsize=None)
def broken_registry() -> Registry:
    return Registry.from_document(BROKEN, "broken")


@lru_cache(maxsize=64)
def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frames(
    spark: SparkSession, sf_dir: str, declared: Registry | None = None, *, only: list[str] | None = None
) -> dict[str, DataFrame]:
    """Contracted frames with planted defects; ``only`` keeps the schemas of other tables unread."""
    def read(session: SparkSession, table: str) -> DataFrame:
        return base(session, sf_dir, table)

    loaded = load_frames(spark, declared or registry(), read, only)
    for table, rules in (("orders", ORDERS_COLUMNS), ("pages", PAGES_COLUMNS)):
        if table in loaded:
            loaded[table] = loaded[table].select(*[F.expr(rule).alias(n) for n, rule in rules.items()])
    return loaded
