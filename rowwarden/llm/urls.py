"""URL filter: a sorted sweep over reversed-host keys, in column functions only.

A rule names a host and a path prefix; it fits a url if the url's host is that host or below it
and the url's path begins with the rule's. The host is written label by label from the top, each
label followed by ``/`` (``com/example/``), so "the host or below it" is a prefix test, a prefix is
an interval of sorted keys, and the intervals nest. ``sweep`` sorts rule keys and row keys
together; what is open at a row is the last rule key at or before it and the rules around that
one, its stack. The sweep runs twice: over hosts, which gives each url the rule hosts around it,
and over rule host and path together, which gives the rules.

Sorted rows are dealt by range, with a row number to tell equal keys apart, so a host that holds
a third of all rows is spread over as many tasks as its rows need. The stack open where a block
begins comes from the blocks before it: one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowwarden.llm.base import query, table
from rowwarden.session import config_frame, stored

# The rules of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"  # verdict on a url that no rule fits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
RULE_PATH = "#"  # between host key and path; neither can hold it


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com/example/www/``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _chains(keys: DataFrame) -> DataFrame:
    """Each rule key with the rule keys that are prefixes of it, itself last."""
    prefixes = keys.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.expr("left(key, n)").alias("outer_key"))
    around = prefixes.join(keys.select(F.col("key").alias("outer_key")), "outer_key")
    return around.groupBy("key").agg(F.array_sort(F.collect_list("outer_key")).alias("stack"))


def sweep(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (key, uid, item) with ``stack``: the rule keys that are prefixes of ``key``, outermost
    first. ``keys`` holds distinct rule keys; ``uid`` only spreads equal keys."""
    opened = _chains(keys).select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("uid"),
        F.lit(None).cast(rows.schema["item"].dataType).alias("item"), "stack")
    passed = rows.select("key", F.lit(1).alias("kind"), "uid", "item", F.lit(None).cast("array<string>").alias("stack"))
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = opened.unionByName(passed).repartitionByRange(blocks, "key", "kind", "uid")
    events = stored(events.withColumn("block", F.spark_partition_id()), "events")
    closing = events.filter("kind = 0").groupBy("block").agg(F.max_by("stack", "key").alias("stack"))
    every = events.select("block").distinct().join(closing, "block", "left")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carried = every.select("block", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.coalesce(F.last("stack", ignorenulls=True).over(so_far), F.col("carried"))
    swept = events.join(carried, "block").withColumn("open", open_).filter("kind = 1")
    return swept.select("key", "uid", "item", F.coalesce(
        F.filter("open", lambda k: F.startswith(F.col("key"), k)), F.array().cast("array<string>")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. The rule of greatest length (host and path together, then
    host) wins; of equal rules, ``block`` does. A null path is the empty one and fits every path; a rule
    without host fits nothing. A null url, and one without ``://``, has an empty host and path and
    gets ``default``. Repeated rows are judged as often as they occur, null ids stay null, other
    columns are not read; an empty table gives no rows, and without rules all get ``default``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parted = pages.select(
        "page_id", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"))
    rows = parted.select(
        host_key(F.col("host")).alias("key"), F.monotonically_increasing_id().alias("uid"),
        F.struct("page_id", "host", "path").alias("item"))
    known = rules.filter("host is not null and host != ''").groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(
        F.max("verdict").alias("verdict")).select("*", host_key(F.col("host")).alias("host_key"))
    known = known.withColumn("key", F.concat("host_key", F.lit(RULE_PATH), "path"))

    hosted = stored(sweep(rows, known.select(F.col("host_key").alias("key")).distinct()), "hosted")
    tried = hosted.select("uid", "item", F.explode("stack").alias("host_key")).select(
        F.concat("host_key", F.lit(RULE_PATH), "item.path").alias("key"), "uid", "item")
    fitting = sweep(tried, known.select("key")).select(
        "uid", "item", F.element_at(F.when(F.size("stack") > 0, F.col("stack")), -1).alias("key"))
    # a key is one character longer than its rule, plus the separator: the same for all rules
    host_length = F.instr("key", RULE_PATH)
    chosen = fitting.groupBy("uid").agg(
        F.first("item").alias("item"),
        F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), host_length.alias("host_n"), "key")))["key"].alias("key"))
    chosen = chosen.select("item", "key").unionByName(
        hosted.filter(F.size("stack") == 0).select("item", F.lit(None).cast("string").alias("key")))
    decided = chosen.join(known.select("key", F.concat("host", "path").alias("rule"), "verdict"), "key", "left")
    return decided.select("item.page_id", "item.host", "item.path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = rf"""
WITH r(host, path, verdict) AS (VALUES {", ".join(str(rule) for rule in RULES)}),
p AS (SELECT row_number() OVER () AS row_id, page_id,
             translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages)
SELECT page_id, p.host, p.path, any_value(r.host || r.path ORDER BY length(r.host || r.path) DESC) AS rule,
       coalesce(any_value(verdict ORDER BY length(r.host || r.path) DESC), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY row_id, page_id, p.host, p.path
"""


@query("op1_url_filter", ORACLE)
def op1(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), config_frame(spark, RULES, "host string, path string, verdict string"))
