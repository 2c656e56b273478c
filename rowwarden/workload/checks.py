"""Registered queries for sources, checks, the suite and remediation targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.contracts import (
    COMPLETENESS,
    REFERENTIAL_INTEGRITY,
    SCHEMA_DRIFT,
    UNIQUENESS,
)
from rowwarden.functions.fingerprint import LANES
from rowwarden.functions.values import fits_dtype
from rowwarden.operators import checks as ops
from rowwarden.operators import remediation as fix
from rowwarden.operators import suite
from rowwarden.operators.conformance import FieldRule, conformance_of
from rowwarden.operators.verdicts import RowVerdicts, readable_checks
from rowwarden.registry import Registry
from rowwarden.sources import tables as sources
from rowwarden.sources import warehouse
from rowwarden.workload import views
from rowwarden.workload.base import query
from rowwarden.workload.views import with_views

DAY = "%Y-%m-%d"
REG = views.registry()
# contracted table -> the relation of the reference database that holds its frame
RELATION = {"orders": "orders_d", "pages": "pages_d"}


def _frames(spark: SparkSession, sf_dir: str, *check_ids: str) -> dict[str, DataFrame]:
    return views.frames(spark, sf_dir, only=REG.tables_of(*check_ids))


def _rows(spark: SparkSession, sf_dir: str, check_id: str, *columns: str) -> DataFrame:
    return ops.failing_rows(REG, check_id, _frames(spark, sf_dir, check_id)).select(*columns)


def relation(table: str) -> str:
    return RELATION.get(table, table)


def failing_sql(check_id: str) -> str:
    """The failing-row condition of a row check over alias ``t``, written for the database."""
    spec = REG.check(check_id)
    column = spec.column
    if spec.dimension == COMPLETENESS:
        return f"{column} IS NULL"
    if spec.contains is not None:
        return f"({column} IS NULL OR NOT contains({column}, '{spec.contains}'))"
    if spec.has_window:
        start, end = spec.window_start_column, spec.window_end_column
        return f"({column} IS NOT NULL AND ({column} < {start} OR {column} > {end}))"
    values = ", ".join(f"'{v}'" for v in REG.contract(spec.table).column(column).allowed_values)
    return f"{column} NOT IN ({values})"


def counts_sql(check_id: str) -> str:
    """(check_id, n_failed, n_total) of one check of the workload registry."""
    spec = REG.check(check_id)
    source = relation(spec.table)
    head = f"SELECT '{check_id}' AS check_id, "
    if spec.dimension == SCHEMA_DRIFT:
        names = ", ".join(f"('{c}')" for c in REG.contract(spec.table).column_names)
        return (
            f"{head}count(*) FILTER (WHERE e.c IS NULL OR o.column_name IS NULL) AS n_failed,"
            f" count(*) AS n_total FROM (VALUES {names}) e(c)"
            f" FULL JOIN (SELECT column_name FROM (DESCRIBE SELECT * FROM {source})) o"
            " ON e.c = o.column_name"
        )
    if spec.dimension == UNIQUENESS:
        keys = ", ".join(spec.business_key)
        present = " AND ".join(f"{k} IS NOT NULL" for k in spec.business_key)
        return (
            f"{head}coalesce(sum(n) FILTER (WHERE n > 1 AND {present}), 0)::BIGINT AS n_failed,"
            f" sum(n)::BIGINT AS n_total FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys})"
        )
    if spec.dimension == REFERENTIAL_INTEGRITY:
        column, parent, ref = REG.contract(spec.table).foreign_key(spec.column)
        return (
            f"{head}count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {relation(parent)} p"
            f" WHERE p.{ref} = t.{column})) AS n_failed, count(*) AS n_total FROM {source} t"
        )
    return (f"{head}count(*) FILTER (WHERE {failing_sql(check_id)}) AS n_failed,"
            f" count(*) AS n_total FROM {source}")


COUNTS = "counts AS (" + " UNION ALL ".join(counts_sql(c) for c in REG.checks) + ")"


# -- sources --------------------------------------------------------------------------------


@query("a1_load_frames", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in REG.contracts)
    + " UNION ALL SELECT 'supplier', count(*) FROM supplier")
def a1_load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``returns`` is contracted but does not exist, and is left out."""
    declared = views.broken_registry()
    frames = sources.load_frames(spark, declared, sources.parquet_reader(sf_dir))
    return sources.table_totals(frames).select("table", "n_rows")


@query("a11_generated_orders", """
SELECT o_orderkey AS order_id, 1 + o_orderkey % 100 AS customer_sk,
       strftime(TIMESTAMP '2025-03-01 00:00:00' + to_hours(o_orderkey), '%Y-%m-%d %H:%M:%S') AS order_ts,
       ['placed','paid','shipped','cancelled','returned'][o_orderkey % 5 + 1] AS status,
       round(20.0 + (o_orderkey % 50) * 3.4, 2)::DOUBLE AS total_amount,
       ['USD','EUR','GBP'][o_orderkey % 3 + 1] AS currency FROM orders
UNION ALL SELECT i + 1000000000, 1, strftime(TIMESTAMP '2025-06-01 00:00:00' + to_hours(i - 9001), '%Y-%m-%d %H:%M:%S'),
       'placed', NULL, 'USD' FROM range(9001, 9006) r(i)
UNION ALL SELECT i + 1000000000, 2, strftime(TIMESTAMP '2025-06-02 00:00:00' + to_hours(i - 9101), '%Y-%m-%d %H:%M:%S'),
       'SHIPPPED', 40.0, 'USD' FROM range(9101, 9104) r(i)
UNION ALL SELECT i + 1000000000, 7, '2025-06-03 12:00:00', 'paid', 55.0, 'USD' FROM range(9201, 9203) r(i)
""")
def a11_generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form orders for the order keys of the given table, with the planted rows."""
    ids = views.base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    made = warehouse.orders(ids, shift=1_000_000_000)
    # written in UTC, whatever the zone of the session
    utc = "TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_micros(order_ts) / 1000000)"
    return made.withColumn("order_ts", F.expr(f"cast({utc} as string)"))


# -- row checks -------------------------------------------------------------------------------


def _row_check(name: str, check_id: str, *columns: str) -> None:
    spec = REG.check(check_id)
    source = relation(spec.table)
    names = [v for v in views.SQL if v == source]
    sql = with_views(f"SELECT {', '.join(columns)} FROM {source} WHERE {failing_sql(check_id)}", *names)
    query(name, sql)(lambda spark, sf_dir: _rows(spark, sf_dir, check_id, *columns))


_row_check("b1_completeness", "orders.o_totalprice.completeness", "o_orderkey")
_row_check("b2_allowed", "orders.o_orderstatus.validity", "o_orderkey", "o_orderstatus")
_row_check("b2_allowed_nulls_pass", "orders.status_nk.validity", "o_orderkey", "status_nk")
_row_check("b2_allowed_events", "events.event_type.validity", "event_id", "event_type")
_row_check("b3_contains", "pages.url.validity", "page_id", "url")
_row_check("b3_contains_nulls_fail", "pages.url_n.validity", "page_id", "url_n")
_row_check("b4_window", "orders.o_orderdate.validity", "o_orderkey")
_row_check("b4_window_null_bounds", "orders.o_orderdate.open_window", "o_orderkey")


def _precedence_registry() -> Registry:
    """One column under every rule at once, then without the text rule, then without the window."""
    order = next(t for t in views.DOCUMENT["tables"] if t["table"] == "orders")
    columns = [{**c, "allowed_values": ["2", "3"]} if c["name"] == "o_orderpriority" else c
               for c in order["columns"]]
    window = {"window_start_column": "o_orderstatus", "window_end_column": "o_orderpriority"}
    rules = {"all": {"contains": "LOW", **window}, "window": window, "half": {
        "window_start_column": "o_orderstatus"}}
    return Registry.from_document({
        "tables": [{**order, "columns": columns, "foreign_keys": []}],
        "checks": [{"check_id": name, "table": "orders", "column": "o_orderpriority",
                    "dimension": "validity", **rule} for name, rule in rules.items()]})


@query("b5_precedence", """
SELECT 'all' AS check_id, count(*) FILTER (WHERE NOT contains(o_orderpriority, 'LOW')) AS n_failed FROM orders
UNION ALL SELECT 'window', count(*) FILTER (WHERE o_orderpriority < o_orderstatus
                                               OR o_orderpriority > o_orderpriority) FROM orders
UNION ALL SELECT 'half', count(*) FILTER (WHERE o_orderpriority NOT IN ('2', '3')) FROM orders
""")
def b5_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir, only=["orders"])
    return suite.run_suite(_precedence_registry(), frames, spark).select("check_id", "n_failed")


@query("b6_structural", with_views("""
SELECT 'orders.o_totalprice.completeness' AS check_id, 'fail' AS status,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS n_failed, count(*) AS n_total,
       (count(*) FILTER (WHERE o_totalprice IS NULL)) || '/' || count(*) || ' null o_totalprice on orders' AS message
FROM orders_d
UNION ALL SELECT * FROM (VALUES
 ('returns.r_order.referential_integrity', 'error', 0, 0,
  'cannot evaluate returns.r_order.referential_integrity: missing table returns'),
 ('supplier.s_phone.completeness', 'error', 0, 0,
  'cannot evaluate supplier.s_phone.completeness: missing column s_phone on supplier'),
 ('supplier.s_suppkey.referential_integrity', 'error', 0, 0,
  'cannot evaluate supplier.s_suppkey.referential_integrity: missing table returns'),
 ('returns.schema_drift', 'fail', 1, 2, 'drift on returns: missing table returns'),
 ('supplier.schema_drift', 'fail', 5, 6,
  'drift on supplier: extra=[''s_acctbal'', ''s_name'', ''s_nationkey''] missing=[''s_phone'', ''s_return'']'))
""", "orders_d"))
def b6_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = views.broken_registry()
    results = suite.run_suite(declared, views.frames(spark, sf_dir, declared), spark)
    return results.select("check_id", "status", "n_failed", "n_total", "message")


# -- keyed checks -------------------------------------------------------------------------------


def _unique_sql(view: str, keys: list[str], pk: str) -> str:
    names = ", ".join(keys)
    same = " AND ".join(f"t.{k} = d.{k}" for k in keys)
    text = (f"SELECT t.{pk} FROM {view} t JOIN (SELECT {names} FROM {view} GROUP BY {names}"
            f" HAVING count(*) > 1) d ON {same}")
    return with_views(text, *[v for v in views.SQL if v == view])


@query("c1_unique_rows", _unique_sql("orders_d", ["o_custkey", "o_orderdate"], "o_orderkey"))
def c1_unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "orders.order_nk.uniqueness", "o_orderkey")


@query("c1_unique_texts", _unique_sql("documents", ["text"], "doc_id"))
def c1_unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "documents.text.uniqueness", "doc_id")


@query("c2_unique_null_keys", with_views("""
SELECT 'suite rows' AS what, coalesce(sum(n) FILTER (WHERE n > 1 AND cust_nk IS NOT NULL), 0)::BIGINT AS n FROM g
UNION ALL SELECT 'sample groups', count(*) FILTER (WHERE n > 1) FROM g
UNION ALL SELECT 'dedupe targets', (sum(n) - count(*))::BIGINT FROM g
""", "orders_d", more="g AS (SELECT cust_nk, o_orderdate, count(*) AS n FROM orders_d GROUP BY ALL)"))
def c2_unique_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a null key part: the suite ignores it, samples and dedupe group it."""
    keys = ["cust_nk", "o_orderdate"]
    check = "orders.null_nk.uniqueness"
    frames = _frames(spark, sf_dir, check)
    parts = {
        "suite rows": ops.failing_rows(REG, check, frames),
        "sample groups": ops.duplicate_groups(frames["orders"], keys, null_groups=True),
        "dedupe targets": fix.target_rows(REG, check, "dedupe_keep_min_pk", frames),
    }
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
               for what, rows in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _orphan_sql(view: str, pk: str, fk: str, parent: str, ref: str) -> str:
    return with_views(
        f"SELECT t.{pk}, t.{fk} AS fk_value FROM {view} t LEFT JOIN (SELECT DISTINCT {ref} FROM {parent}) p"
        f" ON p.{ref} = t.{fk} WHERE p.{ref} IS NULL", *[v for v in views.SQL if v == view])


@query("c3_orphans", _orphan_sql("orders_d", "o_orderkey", "cust_ref", "customer", "c_custkey"))
def c3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "orders.cust_ref.referential_integrity", "o_orderkey",
                 F.col("cust_ref").alias("fk_value"))


@query("c3_orphans_null_fk", _orphan_sql("orders_d", "o_orderkey", "cust_nk", "customer", "c_custkey"))
def c3_orphans_null_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "orders.cust_nk.referential_integrity", "o_orderkey",
                 F.col("cust_nk").alias("fk_value"))


@query("c3_orphans_natural", _orphan_sql("documents", "doc_id", "doc_id", "labels", "doc_id"))
def c3_orphans_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "documents.doc_id.referential_integrity", "doc_id",
                 F.col("doc_id").alias("fk_value"))


@query("c4_dup_groups", with_views(
    f"SELECT cust_nk, strftime(o_orderdate, '{DAY}') AS day, count(*) AS n FROM orders_d"
    " GROUP BY cust_nk, o_orderdate HAVING count(*) > 1", "orders_d"))
def c4_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All duplicate groups, null keys included, as sampling sees them before its limit."""
    rows = views.frames(spark, sf_dir, only=["orders"])["orders"]
    groups = ops.duplicate_groups(rows, ["cust_nk", "o_orderdate"], null_groups=True)
    return groups.select("cust_nk", F.col("o_orderdate").cast("date").cast("string").alias("day"), "n")


@query("c4_dup_group_sample", with_views(
    f"SELECT cust_nk, strftime(o_orderdate, '{DAY}') AS day, count(*) AS n FROM orders_d"
    " GROUP BY cust_nk, o_orderdate HAVING count(*) > 1"
    " ORDER BY cust_nk NULLS FIRST, o_orderdate LIMIT 20", "orders_d"))
def c4_dup_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = ops.sample_rows(REG, "orders.null_nk.uniqueness", _frames(spark, sf_dir, "orders.null_nk.uniqueness"))
    return sample.select("cust_nk", F.col("o_orderdate").cast("date").cast("string").alias("day"), "n")


@query("c5_orphan_sample", with_views(
    "SELECT o_orderkey, cust_ref FROM orders_d t WHERE NOT EXISTS"
    " (SELECT 1 FROM customer c WHERE c.c_custkey = t.cust_ref) ORDER BY o_orderkey LIMIT 20", "orders_d"))
def c5_orphan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(REG, "orders.cust_ref.referential_integrity", _frames(spark, sf_dir, "orders.cust_ref.referential_integrity"))


@query("c6_sample", with_views(
    "SELECT o_orderkey, o_orderstatus FROM orders_d WHERE o_orderstatus NOT IN ('O', 'F')"
    " ORDER BY o_orderkey LIMIT 20", "orders_d"))
def c6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(REG, "orders.o_orderstatus.validity", _frames(spark, sf_dir, "orders.o_orderstatus.validity"))


@query("c7_sample_dispatch", with_views(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(open_from, '%Y-%m-%d') AS lower,"
    " strftime(open_to, '%Y-%m-%d') AS upper FROM orders_d"
    " WHERE o_orderdate IS NOT NULL AND (o_orderdate < open_from OR o_orderdate > open_to)"
    " ORDER BY o_orderkey LIMIT 100", "orders_d"))
def c7_sample_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sample a caller may ask for, of a window check with its bounds."""
    sample = ops.sample_rows(REG, "orders.o_orderdate.open_window", _frames(spark, sf_dir, "orders.o_orderdate.open_window"), 100)
    text = lambda name, to: F.col(name).cast("date").cast("string").alias(to)
    return sample.select("o_orderkey", text("o_orderdate", "day"), text("open_from", "lower"),
                         text("open_to", "upper"))


def _drift_sql() -> str:
    parts = []
    for table, contract in views.broken_registry().contracts.items():
        if table == "returns":
            parts.append("SELECT 'returns' AS \"table\", 'missing_table' AS kind, 'returns' AS \"column\"")
            continue
        names = ", ".join(f"('{c}')" for c in contract.column_names)
        parts.append(
            f"SELECT '{table}' AS \"table\", CASE WHEN e.c IS NULL THEN 'extra' ELSE 'missing' END AS kind,"
            f" coalesce(e.c, o.column_name) AS \"column\" FROM (VALUES {names}) e(c) FULL JOIN"
            f" (SELECT column_name FROM (DESCRIBE SELECT * FROM {relation(table)})) o"
            " ON e.c = o.column_name WHERE e.c IS NULL OR o.column_name IS NULL")
    return with_views(" UNION ALL ".join(parts), "orders_d", "pages_d")


@query("c8_schema_drift", _drift_sql())
def c8_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = views.broken_registry()
    return ops.drift_frame(declared, views.frames(spark, sf_dir, declared), spark)


CONFORMANCE = {
    "customer": [FieldRule("c_custkey", "int64"), FieldRule("c_acctbal", "float64", ge=0.0),
                 FieldRule("c_mktsegment", "utf8", isin=("AUTOMOBILE", "BUILDING"))],
    "part": [FieldRule("p_size", "int64", gt=1, le=40), FieldRule("p_retailprice", "float64", ge=0.0)],
    "events": [FieldRule("props", "int64"), FieldRule("value", "float64", gt=1.0),
               FieldRule("absent", "utf8")],
    "orders": [FieldRule("o_totalprice", "float64", nullable=True, ge=1000.0),
               FieldRule("status_nk", "utf8", isin=("O", "F")),
               FieldRule("o_orderpriority", "date", nullable=True)],
}
_RULE_SQL = {
    ("customer", "c_custkey", "coercible"): "c_custkey IS NOT NULL AND TRY_CAST(c_custkey AS BIGINT) IS NULL",
    ("customer", "c_custkey", "not_null"): "c_custkey IS NULL",
    ("customer", "c_acctbal", "coercible"): "c_acctbal IS NOT NULL AND TRY_CAST(c_acctbal AS DOUBLE) IS NULL",
    ("customer", "c_acctbal", "not_null"): "c_acctbal IS NULL",
    ("customer", "c_acctbal", "ge"): "c_acctbal < 0",
    ("customer", "c_mktsegment", "coercible"): "FALSE",
    ("customer", "c_mktsegment", "not_null"): "c_mktsegment IS NULL",
    ("customer", "c_mktsegment", "isin"): "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')",
    ("part", "p_size", "coercible"): "FALSE",
    ("part", "p_size", "not_null"): "p_size IS NULL",
    ("part", "p_size", "gt"): "p_size <= 1",
    ("part", "p_size", "le"): "p_size > 40",
    ("part", "p_retailprice", "coercible"): "FALSE",
    ("part", "p_retailprice", "not_null"): "p_retailprice IS NULL",
    ("part", "p_retailprice", "ge"): "p_retailprice < 0",
    ("events", "props", "coercible"): "props IS NOT NULL AND TRY_CAST(props AS BIGINT) IS NULL",
    ("events", "props", "not_null"): "props IS NULL",
    ("events", "value", "coercible"): "FALSE",
    ("events", "value", "not_null"): '"value" IS NULL',
    ("events", "value", "gt"): '"value" <= 1',
    ("events", "absent", "present"): "TRUE",
    ("orders", "o_totalprice", "coercible"): "FALSE",
    ("orders", "o_totalprice", "ge"): "o_totalprice < 1000",
    ("orders", "status_nk", "coercible"): "FALSE",
    ("orders", "status_nk", "not_null"): "status_nk IS NULL",
    ("orders", "status_nk", "isin"): "status_nk NOT IN ('O', 'F')",
    ("orders", "o_orderpriority", "coercible"):
        "o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS DATE) IS NULL",
}


@query("c9_conformance", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{r}' AS rule,"
    f" count(*) FILTER (WHERE {sql}) AS n_failed, count(*) AS n_total FROM {relation(t)}"
    for (t, c, r), sql in _RULE_SQL.items()), "orders_d"))
def c9_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {**views.frames(spark, sf_dir, only=["customer", "events", "orders"]),
              "part": views.base(spark, sf_dir, "part")}
    return conformance_of(frames, CONFORMANCE)


# -- suite ----------------------------------------------------------------------------------


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.run_suite(REG, views.frames(spark, sf_dir), spark)


@query("d1_suite", with_views(
    "SELECT check_id, CASE WHEN n_failed > 0 THEN 'fail' ELSE 'pass' END AS status, n_failed, n_total"
    " FROM counts", "orders_d", "pages_d", more=COUNTS))
def d1_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).select("check_id", "status", "n_failed", "n_total")


def _message_sql() -> str:
    cases = []
    for spec in REG.checks.values():
        t, c = spec.table, spec.column
        text = {
            COMPLETENESS: f"n_failed || '/' || n_total || ' null {c} on {t}'",
            UNIQUENESS: f"n_failed || ' rows share ({', '.join(spec.business_key)})'",
            REFERENTIAL_INTEGRITY: f"n_failed || ' orphan {c} on {t}'",
            SCHEMA_DRIFT: f"'{t} matches contract ({len(REG.contract(t).columns)} columns)'",
        }.get(spec.dimension) or (
            "n_failed || ' visits outside window'" if spec.has_window
            else f"n_failed || ' illegal {c} values'")
        if spec.check_id == "lineitem.schema_drift":
            text = "'drift on lineitem: extra=[''l_tax''] missing=[''l_comment'']'"
        cases.append(f"WHEN '{spec.check_id}' THEN {text}")
    return f"SELECT check_id, CASE check_id {' '.join(cases)} END AS message FROM counts"


def _masks_sql() -> str:
    """Sets of failed row rules and references, row by row."""
    parts = []
    for table in dict.fromkeys(s.table for s in REG.checks.values() if s.dimension != SCHEMA_DRIFT):
        tests = {}
        for spec in REG.checks.values():
            if spec.table == table and spec.dimension == REFERENTIAL_INTEGRITY:
                column, parent, ref = REG.contract(table).foreign_key(spec.column)
                tests[spec.check_id] = f"NOT EXISTS (SELECT 1 FROM {relation(parent)} p WHERE p.{ref} = t.{column})"
            elif spec.table == table and spec.dimension not in (SCHEMA_DRIFT, UNIQUENESS):
                tests[spec.check_id] = failing_sql(spec.check_id)
        flags = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in sorted(tests.items()))
        parts.append(f"SELECT '{table}' AS \"table\", coalesce(array_to_string([{flags}], ','), '') AS failed, count(*) AS n_rows"
                     f" FROM {relation(table)} t GROUP BY ALL")
    return with_views(" UNION ALL ".join(parts), "orders_d", "pages_d")


@query("d1_masks", _masks_sql())
def d1_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the exact set of rules they fail, from the one narrow table that all checks share."""
    frames = views.frames(spark, sf_dir)
    found = RowVerdicts(REG, frames, spark, readable_checks(REG, frames)).masks()
    return found.select("table", F.array_join("failed", ",").alias("failed"), "n_rows")


@query("d4_messages", with_views(_message_sql(), "orders_d", "pages_d", more=COUNTS))
def d4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).select("check_id", "message")


def _sample_sql() -> str:
    parts = []
    for spec in REG.checks.values():
        source = relation(spec.table)
        if spec.dimension == SCHEMA_DRIFT:
            continue
        pk = REG.contract(spec.table).single_key
        if spec.dimension == UNIQUENESS:
            keys = ", ".join(spec.business_key)
            present = " AND ".join(f"{k} IS NOT NULL" for k in spec.business_key)
            rows = (f"(SELECT {pk} FROM (SELECT {pk}, count(*) OVER (PARTITION BY {keys}) AS n"
                    f" FROM {source} WHERE {present}) WHERE n > 1)")
        elif spec.dimension == REFERENTIAL_INTEGRITY:
            column, parent, ref = REG.contract(spec.table).foreign_key(spec.column)
            rows = (f"(SELECT {pk} FROM {source} t WHERE NOT EXISTS (SELECT 1 FROM {relation(parent)} p"
                    f" WHERE p.{ref} = t.{column}))")
        else:
            rows = f"(SELECT {pk} FROM {source} WHERE {failing_sql(spec.check_id)})"
        shown = [name for name in SAMPLED[spec.table]]
        body = ", ".join(f"'{n}': {n}{'::VARCHAR' if n in TIMES else ''}" for n in shown)
        parts.append(f"SELECT '{spec.check_id}' AS check_id, {pk}::VARCHAR AS row_key, to_json({{{body}}})::VARCHAR AS sample FROM"
                     f" (SELECT * FROM {source} WHERE {pk} IN (SELECT {pk} FROM {rows} ORDER BY {pk} LIMIT 20))")
    for kind, name in (("extra", "l_tax"), ("missing", "l_comment")):
        parts.append(f"SELECT 'lineitem.schema_drift', '{kind}|{name}', to_json({{'kind': '{kind}', 'column': '{name}'}})::VARCHAR")
    return with_views(" UNION ALL ".join(parts), "orders_d", "pages_d")


TIMES = ("o_orderdate", "valid_from", "valid_to", "open_from", "open_to", "ts")
# the columns of each frame, in their order
SAMPLED = {
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": tuple(views.ORDERS_COLUMNS), "pages": tuple(views.PAGES_COLUMNS),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}


@query("d5_samples", _sample_sql())
def d5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled rows of every check with their text."""
    return suite.failure_samples(REG, views.frames(spark, sf_dir))


@query("d5_lost_key", with_views(
    "SELECT check_id, to_json({'o_orderdate': o_orderdate::VARCHAR, 'status_nk': status_nk})::VARCHAR AS sample FROM ("
    " SELECT 'orders.status_nk.validity' AS check_id, o_orderdate, status_nk, row_number() OVER (ORDER BY"
    " to_json({'o_orderdate': o_orderdate::VARCHAR, 'status_nk': status_nk})::VARCHAR) AS n FROM orders_d"
    " WHERE status_nk NOT IN ('O', 'F')) WHERE n <= 20", "orders_d"))
def d5_lost_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a table whose key column was dropped: the first rows by their text."""
    check = "orders.status_nk.validity"
    rows = _frames(spark, sf_dir, check)["orders"].select("o_orderdate", "status_nk")
    return suite.failure_samples(REG, {"orders": rows}, [check]).select("check_id", "sample")


# The rules by which defects were planted, which say how many failures to expect at any scale; the last check
# is not declared, and every declared one that is not named here is expected to pass.
PLANTED = {
    "orders.o_totalprice.completeness": "o_orderkey % 97 = 0",
    "orders.cust_ref.referential_integrity": "o_orderkey % 89 = 0",
    "orders.cust_nk.referential_integrity": "o_custkey % 10 = 0",
    "returns.r_order.referential_integrity": "o_orderkey % 2 = 0",
}


@query("d11_reconcile", with_views(
    "SELECT coalesce(e.check_id, c.check_id) AS check_id, coalesce(e.n, 0) AS n_expected,"
    " coalesce(c.n_failed, 0) AS n_failed, coalesce(e.n, 0) = coalesce(c.n_failed, 0) AS matches"
    " FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS check_id, count(*) FILTER (WHERE {rule}) AS n FROM orders" for k, rule in PLANTED.items())
    + ") e FULL JOIN counts c ON c.check_id = e.check_id",
    "orders_d", "pages_d", more=COUNTS))
def d11_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = views.base(spark, sf_dir, "orders").agg(*[F.count_if(F.expr(rule)).alias(f"n{k}") for k, rule in enumerate(PLANTED.values())])
    pairs = [F.struct(F.lit(check_id).alias("check_id"), F.col(f"n{k}").alias("n_expected")) for k, check_id in enumerate(PLANTED)]
    wanted = counted.select(F.inline(F.array(*pairs)))
    return suite.reconcile(run(spark, sf_dir), wanted)


# -- remediation targets -----------------------------------------------------------------------


def _targets(spark: SparkSession, sf_dir: str, check_id: str, action_id: str, pk: str) -> DataFrame:
    return fix.target_rows(REG, check_id, action_id, _frames(spark, sf_dir, check_id)).select(pk)


def target_sql(check_id: str, action_id: str) -> str:
    """The target keys of a policy as ``SELECT k``."""
    spec = REG.check(check_id)
    source, pk = relation(spec.table), REG.contract(spec.table).single_key
    if action_id == "dedupe_keep_min_pk":
        keys = ", ".join(spec.business_key)
        return (f"SELECT {pk} AS k FROM {source} WHERE {pk} NOT IN"
                f" (SELECT min({pk}) FROM {source} GROUP BY {keys})")
    if action_id == "quarantine_orphans":
        column, parent, ref = REG.contract(spec.table).foreign_key(spec.column)
        return (f"SELECT {pk} AS k FROM {source} t WHERE NOT EXISTS"
                f" (SELECT 1 FROM {relation(parent)} p WHERE p.{ref} = t.{column})")
    if action_id in ("no_op_alert", "schema_drift_ticket"):
        return f"SELECT 0 AS k FROM {source} WHERE FALSE"
    condition = f"{spec.column} IS NULL" if action_id == "null_fill" else failing_sql(check_id)
    return f"SELECT {pk} AS k FROM {source} WHERE {condition}"


for _name, _check, _action, _pk in (
    ("e1_nulls", "orders.o_totalprice.completeness", "quarantine_nulls", "o_orderkey"),
    ("e2_invalids_allowed", "orders.status_nk.validity", "quarantine_invalids", "o_orderkey"),
    ("e2_invalids_contains", "pages.url_n.validity", "quarantine_invalids", "page_id"),
    ("e2_invalids_window", "orders.o_orderdate.open_window", "quarantine_invalids", "o_orderkey"),
    ("e3_orphans", "orders.cust_nk.referential_integrity", "quarantine_orphans", "o_orderkey"),
    ("e4_dedupe", "orders.null_nk.uniqueness", "dedupe_keep_min_pk", "o_orderkey"),
    ("e4_dedupe_texts", "documents.text.uniqueness", "dedupe_keep_min_pk", "doc_id"),
):
    query(_name, with_views(f"SELECT k AS {_pk} FROM ({target_sql(_check, _action)})", "orders_d", "pages_d"))(
        lambda spark, sf_dir, c=_check, a=_action, p=_pk: _targets(spark, sf_dir, c, a, p))


@query("e5_null_fill", with_views(
    "SELECT o_orderkey, coalesce(o_totalprice, 0.0)::DOUBLE AS o_totalprice FROM orders_d", "orders_d"))
def e5_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the filled table, not only the filled ones."""
    check = "orders.o_totalprice.completeness"
    filled = fix.filled_rows(REG, check, _frames(spark, sf_dir, check))
    return filled.select("o_orderkey", "o_totalprice")


@query("e6_e7_noop", with_views(
    "SELECT check_id, 'schema_drift_ticket' AS action_id, n_failed FROM counts"
    " WHERE n_failed > 0 AND check_id LIKE '%.schema_drift'"
    " UNION ALL SELECT check_id, 'no_op_alert', n_failed FROM counts"
    " WHERE n_failed > 0 AND check_id = 'pages.url.uniqueness'",
    "orders_d", "pages_d", more=COUNTS))
def e6_e7_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts and tickets of failed checks whose policy changes nothing."""
    return fix.notices(run(spark, sf_dir), REG.policies_frame(spark)).select(
        "check_id", "action_id", "n_failed")


@query("e8_quarantine_row", with_views(
    "SELECT 'run-1' AS run_id, 'warehouse.orders' AS table_name,"
    " '{\"o_orderkey\":' || k || '}' AS pk_json, 'dedupe_keep_min_pk' AS reason,"
    " o_custkey AS payload_custkey, o_orderpriority AS payload_priority FROM ("
    + target_sql("orders.null_nk.uniqueness", "dedupe_keep_min_pk")
    + ") x JOIN orders_d ON o_orderkey = k", "orders_d"))
def e8_quarantine_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copied rows; of the payload, the parts both engines write alike."""
    check = "orders.null_nk.uniqueness"
    rows = fix.quarantine_rows(REG, check, "dedupe_keep_min_pk", _frames(spark, sf_dir, check), "run-1")
    inside = F.from_json("payload", "o_custkey bigint, o_orderpriority string")
    return rows.select("run_id", "table_name", "pk_json", "reason",
                       inside["o_custkey"].alias("payload_custkey"),
                       inside["o_orderpriority"].alias("payload_priority"))


_RAW = ("CASE event_type WHEN 'view' THEN CAST(user_id AS STRING) WHEN 'click' THEN"
        " CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'yes' END WHEN 'purchase' THEN"
        " CASE WHEN user_id % 2 = 0 THEN '2024-02-29' ELSE '2023-02-29' END WHEN 'signup' THEN"
        " CASE WHEN user_id % 2 = 0 THEN '2024-01-05 10:20:30' ELSE '12.5' END ELSE props END")
_KIND = ("CASE user_id % 6 WHEN 0 THEN 'int64' WHEN 1 THEN 'float64' WHEN 2 THEN 'utf8'"
         " WHEN 3 THEN 'date' WHEN 4 THEN 'datetime' ELSE 'bool' END")


@query("e9_fill_values", f"""
SELECT event_id, dtype, coalesce(CASE dtype
  WHEN 'int64' THEN regexp_full_match(raw, '[+-]?[0-9]+') AND TRY_CAST(raw AS BIGINT) IS NOT NULL
  WHEN 'float64' THEN TRY_CAST(raw AS DOUBLE) IS NOT NULL AND raw <> 'true'
  WHEN 'utf8' THEN raw IS NOT NULL
  WHEN 'date' THEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(raw AS DATE) IS NOT NULL
  WHEN 'datetime' THEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(raw AS TIMESTAMP) IS NOT NULL
  ELSE raw IN ('true', 'false') END, FALSE) AS fits
FROM (SELECT event_id, {_KIND} AS dtype, {_RAW.replace('STRING', 'VARCHAR')} AS raw FROM events)
""")
def e9_fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a textual constant fit the contract type? One constant per event."""
    rows = views.base(spark, sf_dir, "events").select(
        "event_id", F.expr(_KIND).alias("dtype"), F.expr(_RAW).alias("raw"))
    return rows.select("event_id", "dtype", fits_dtype(F.col("raw"), F.col("dtype")).alias("fits"))


def digits_sql(text: str) -> str:
    """A row hash: SHA-256 of the tagged key."""
    return f"sha256(coalesce('k' || ({text}), 'n'))"


def lanes_sql(hashed: str) -> str:
    """The digest text of a set of row hashes, lane by lane."""
    lanes = " || '|' || ".join(
        f"coalesce(sum(('0x' || substr({hashed}, {first}, {digits}))::BIGINT), 0)::VARCHAR"
        for first, digits in LANES)
    return f"count({hashed})::VARCHAR || '|' || {lanes}"


def summary_sql(check_id: str, action_id: str) -> str:
    table = REG.check(check_id).table
    return (f"SELECT '{check_id}' AS check_id, '{action_id}' AS action_id, count(*) AS target_count,"
            f" 'sha256:' || sha256('{table}|{action_id}|' || {lanes_sql('h')}) AS target_fingerprint"
            f" FROM (SELECT {digits_sql('k::VARCHAR')} AS h FROM ({target_sql(check_id, action_id)}))")


_POLICIES = [(s.check_id, p.action_id) for s in REG.checks.values() for p in s.policies]


@query("e11_fingerprint", with_views(
    " UNION ALL ".join(summary_sql(*p) for p in _POLICIES), "orders_d", "pages_d"))
def e11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix.target_sets(REG, views.frames(spark, sf_dir), spark).select(
        "check_id", "action_id", "target_count", "target_fingerprint")


# what changed between planning and applying: prices of urgent orders were lost
_CHANGED = "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END"


def _recheck_sql() -> str:
    later = "now_orders AS (SELECT * REPLACE (" + _CHANGED + " AS o_totalprice) FROM orders_d)"
    wanted = [p for p in _POLICIES if REG.check(p[0]).table == "orders"]
    parts = []
    for policy in wanted:
        then = target_sql(*policy)
        now = then.replace("orders_d", "now_orders")
        parts.append(
            f"SELECT '{policy[0]}' AS check_id, '{policy[1]}' AS action_id, NOT EXISTS (("
            f"(SELECT k FROM ({then})) EXCEPT (SELECT k FROM ({now}))) UNION ALL"
            f" ((SELECT k FROM ({now})) EXCEPT (SELECT k FROM ({then})))) AS unchanged")
    return with_views(" UNION ALL ".join(parts), "orders_d", more=later)


@query("e12_recheck", _recheck_sql())
def e12_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [p for p in _POLICIES if REG.check(p[0]).table == "orders"]
    frames = _frames(spark, sf_dir, *[check_id for check_id, _ in wanted])
    planned = fix.target_sets(REG, frames, spark, wanted)
    later = {**frames, "orders": frames["orders"].withColumn("o_totalprice", F.expr(_CHANGED))}
    return fix.recheck(planned, fix.target_sets(REG, later, spark, wanted)).select(
        "check_id", "action_id", "unchanged")


@query("i7_catalog", " UNION ALL ".join(
    f"SELECT '{c.table}' AS \"table\", '{c.contract_id}' AS contract_id, '{','.join(c.primary_key)}' AS primary_key,"
    f" {len(c.columns)}::BIGINT AS n_contracted,"
    f" {sum(s.table == c.table for s in REG.checks.values())}::BIGINT AS n_checks,"
    f" count(*) AS n_rows FROM {c.table}" for c in REG.contracts.values()))
def i7_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog views joined: tables, their columns and checks, and what is stored."""
    columns = REG.columns_frame(spark).groupBy("table").agg(F.count(F.lit(1)).alias("n_contracted"))
    checks = REG.checks_frame(spark).groupBy("table").agg(F.count(F.lit(1)).alias("n_checks"))
    totals = sources.table_totals(views.frames(spark, sf_dir)).select("table", "n_rows")
    return (
        REG.tables_frame(spark).join(columns, "table").join(checks, "table", "left").join(totals, "table")
        .select("table", "contract_id", F.array_join("primary_key", ",").alias("primary_key"),
                "n_contracted", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), "n_rows"))
