"""Joins upon joins read each input about once: the size of a plan does not multiply with every join."""

import pytest
from pyspark.sql import functions as F

from rowwarden.operators.joins import skew_join


def leaves(frame):
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def lookup(spark, n):
    return spark.range(50).select(F.col("id").alias("k"), (F.col("id") * n).alias(f"v{n}"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_read_their_rows_once(spark, no_broadcast, how):
    joined = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 70).alias("k"))
    wanted = joined
    for n in range(1, 5):
        joined = skew_join(joined, lookup(spark, n), ["k"], how)
        wanted = wanted.join(lookup(spark, n), ["k"], how)
    assert leaves(joined) == 5
    names = sorted(joined.columns)
    assert sorted(map(str, joined.select(names).collect())) == sorted(map(str, wanted.select(names).collect()))


def test_a_hot_key_found_by_counting_is_still_split(spark, no_broadcast):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 40).alias("k"))
    joined = skew_join(rows, lookup(spark, 2), ["k"], "left", hot_rows=100)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and leaves(joined) > 2
    assert joined.count() == 300 and joined.filter("v2 = 2 * k").count() == 300
