"""Time design choices against their alternatives: python tools/alternatives.py [sf ...]"""

from __future__ import annotations

import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.operators import checks, remediation, suite
from rowwarden.session import local_session
from rowwarden.workload import views

REG = views.registry()
KEYS = ["cust_nk", "o_orderdate"]


def one_job_per_check(spark, frames):
    parts = [checks.failing_rows(REG, c, frames).agg(F.count(F.lit(1)).alias("n")) for c in REG.checks]
    return reduce(DataFrame.union, parts)


def not_in(spark, frames):
    frames["orders"].createOrReplaceTempView("alt_orders")
    return spark.sql("SELECT o_orderkey FROM alt_orders WHERE o_orderkey NOT IN"
                     " (SELECT min(o_orderkey) FROM alt_orders GROUP BY cust_nk, o_orderdate)")


def shuffled(build):
    def run(spark, frames):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return build(spark, frames)
    return run


def orphans(spark, frames):
    return checks.failing_rows(REG, "orders.cust_ref.referential_integrity", frames)


CASES = {
    "suite, fused": lambda spark, frames: suite.run_suite(REG, frames, spark),
    "suite, one job per check": one_job_per_check,
    "dedupe, counted groups joined back": lambda spark, frames: remediation.target_rows(
        REG, "orders.null_nk.uniqueness", "dedupe_keep_min_pk", frames).select("o_orderkey"),
    "dedupe, NOT IN subquery": not_in,
    "orphans, parent broadcast": orphans,
    "orphans, no broadcast allowed": shuffled(orphans),
    "target sets of all policies": lambda spark, frames: remediation.target_sets(REG, frames, spark),
}


def main() -> None:
    spark = local_session(8, app="alternatives")
    spark.sparkContext.setLogLevel("ERROR")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for sf in sys.argv[1:] or ["0.01", "0.1"]:
        frames = views.frames(spark, f"/root/testdata/sf{sf}")
        for name, build in CASES.items():
            for _ in range(3):
                start = time.perf_counter()
                build(spark, frames).write.format("noop").mode("overwrite").save()
                seconds = time.perf_counter() - start
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
            print(f"sf{sf}  {name:40s} {seconds:6.2f} s", flush=True)


if __name__ == "__main__":
    main()
