"""Large-side and hot-key paths against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from rowwarden.functions.fingerprint import row_hash, set_digest
from rowwarden.operators import checks, remediation
from rowwarden.operators.joins import fits_broadcast, skew_join


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one key and a tenth have none."""
    rng = random.Random(7)
    data = []
    for n in range(3000):
        key = 1 if n % 3 == 0 else None if n % 10 == 1 else rng.randrange(2, 1500)
        data.append((n, key, rng.choice(["a", "b", None])))
    return spark.createDataFrame(data, "id long, k long, s string").repartition(4), data


def ids(frame):
    return sorted(row.id for row in frame.select("id").collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("hot_rows", [100, 10**7])
def test_skew_join_equals_plain_join(spark, rows, no_broadcast, how, null_safe, hot_rows):
    frame, data = rows
    known = [(k,) for k in [None, *range(1, 700)]]
    lookup = spark.createDataFrame(known, "k long").withColumn("found", F.lit(True))
    assert not fits_broadcast(lookup)
    lookup = lookup if how in ("inner", "left") else lookup.select("k")
    joined = skew_join(frame, lookup, ["k"], how, null_safe=null_safe, hot_rows=hot_rows)
    match = lambda k: (k is None and null_safe) or (k is not None and k < 700)
    wanted = {"inner": match, "left": lambda k: True, "left_semi": match, "left_anti": lambda k: not match(k)}[how]
    assert ids(joined) == [n for n, k, _ in data if wanted(k)]
    if how == "left":
        assert ids(joined.filter("found")) == [n for n, k, _ in data if match(k)]


def test_duplicates_and_surplus(rows, no_broadcast):
    frame, data = rows
    groups = collections.defaultdict(list)
    for n, k, s in data:
        groups[k, s].append(n)
    wanted = sorted(n for (k, s), g in groups.items() if len(g) > 1 and k is not None and s is not None for n in g)
    assert ids(checks.duplicate_rows(frame, ["k", "s"])) == wanted
    surplus = sorted(n for g in groups.values() for n in g if n != min(g))
    assert ids(remediation.surplus_rows(frame, ["k", "s"], "id", hot_rows=50)) == surplus
    assert ids(remediation.surplus_rows(frame, ["k", "s"], "id")) == surplus


def test_orphans(spark, rows, no_broadcast):
    frame, data = rows
    parents = spark.range(2, 800).select(F.col("id").alias("k"))
    wanted = [n for n, k, _ in data if k is None or not 2 <= k < 800]
    assert ids(checks.orphan_rows(frame, "k", parents)) == wanted
    twice = parents.union(parents)
    assert ids(checks.orphan_rows(frame, "k", twice)) == wanted


def test_set_digest(spark):
    def digest(frame, label="t"):
        return frame.select(row_hash(F.col("id")).alias("h")).agg(
            set_digest("h", label).alias("d")).head().d

    base = digest(spark.range(0, 1000))
    assert base == digest(spark.range(0, 1000).repartition(7).orderBy(F.desc("id")))
    others = [spark.range(0, 999), spark.range(1, 1001), spark.range(0, 1000).union(spark.range(5, 6)),
              spark.range(0, 0)]
    digests = [digest(frame) for frame in others] + [digest(spark.range(0, 1000), "u")]
    assert len({base, *digests}) == 6


def test_plans_broadcast_only_what_fits(spark, rows, no_broadcast):
    frame, _ = rows
    parents = spark.range(2, 800).select(F.col("id").alias("k"))
    plan = checks.orphan_groups(frame, "k", parents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_null_keys_pass_by_the_join(spark, no_broadcast):
    """A third of nulls: kept by left and left_anti, matched by nothing, and column order stays."""
    from rowwarden.operators.joins import skew_join

    rows = spark.range(90).selectExpr("id AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS k", "id * 2 AS b")
    lookup = spark.createDataFrame([(0, "x"), (1, "y"), (None, "z")], "k long, v string")
    left = skew_join(rows, lookup, ["k"], "left", hot_rows=5)
    assert left.columns == ["a", "k", "b", "v"] and left.count() == 90
    assert left.filter("k IS NULL AND v IS NULL").count() == 30 and left.filter("v IS NOT NULL").count() == rows.filter("k < 2").count()
    anti = skew_join(rows, lookup, ["k"], "left_anti", hot_rows=5)
    assert anti.columns == rows.columns and anti.count() == 90 - rows.filter("k < 2").count()


def test_orphans_keep_the_column_order(spark, no_broadcast):
    from rowwarden.operators.checks import orphan_rows

    rows = spark.createDataFrame([(2, 7, 9), (3, 8, None)], "id long, a long, fk long")
    parents = spark.createDataFrame([(1,)], "fk long")
    shuffled = orphan_rows(rows, "fk", parents)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10mb")
    broadcast = orphan_rows(rows, "fk", parents)
    assert shuffled.columns == broadcast.columns == rows.columns
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, broadcast.collect())) == [(2, 7, 9), (3, 8, None)]
