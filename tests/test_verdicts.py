"""Row verdicts: one scan per table, digests with and without collisions, samples and target sets."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowwarden.operators import checks, digests, remediation, suite
from rowwarden.operators.verdicts import RowVerdicts, readable_checks
from rowwarden.registry import Registry
from rowwarden.session import stored

COLUMNS = [{"name": n, "dtype": d} for n, d in (("id", "int64"), ("name", "utf8"), ("part", "utf8"), ("day", "date"), ("ref", "int64"), ("kind", "utf8"))]
COLUMNS[-1]["allowed_values"] = ["a", "b"]
DOCUMENT = {
    "action_tables": {"dedupe_keep_min_pk": ["t"], "quarantine_orphans": ["t"]},
    "tables": [
        {"table": "t", "primary_key": ["id"], "columns": COLUMNS, "foreign_keys": [["ref", "p", "pid"]]},
        {"table": "p", "primary_key": ["pid"], "columns": [{"name": "pid", "dtype": "int64"}]},
    ],
    "checks": [
        {"check_id": "t.name.completeness", "table": "t", "column": "name", "dimension": "completeness",
         "policies": [{"action_id": "quarantine_nulls"}]},
        {"check_id": "t.kind.validity", "table": "t", "column": "kind", "dimension": "validity",
         "policies": [{"action_id": "quarantine_invalids"}]},
        {"check_id": "t.names.uniqueness", "table": "t", "column": "name", "dimension": "uniqueness", "business_key": ["name", "part"],
         "policies": [{"action_id": "dedupe_keep_min_pk", "parameters": {"business_key": ["name", "part"]}}]},
        {"check_id": "t.days.uniqueness", "table": "t", "column": "day", "dimension": "uniqueness", "business_key": ["day", "ref"],
         "policies": [{"action_id": "dedupe_keep_min_pk", "parameters": {"business_key": ["day", "ref"]}}]},
        {"check_id": "t.ref.referential_integrity", "table": "t", "column": "ref", "dimension": "referential_integrity",
         "policies": [{"action_id": "quarantine_orphans"}]},
    ],
}
REG = Registry.from_document(DOCUMENT, "verdicts")
POLICIES = [(s.check_id, p.action_id) for s in REG.checks.values() for p in s.policies]
SCHEMA = "id long, name string, part string, day date, ref long, kind string"


def rows_like(n, seed=0):
    rng = random.Random(seed)
    return [(k, rng.choice([None, "x", "y" * 50, "hot"]), rng.choice([None, "1", "2"]), datetime.date(2024, 1, rng.randint(1, 9)) if rng.random() < 0.9 else None,
             rng.choice([None, 1, 2, 3, 77]), rng.choice([None, "a", "b", "c"])) for k in range(n)]


def plain(rows, parents):
    """Failing keys per check and target keys per dedupe."""
    failed = {
        "t.name.completeness": [r[0] for r in rows if r[1] is None],
        "t.kind.validity": [r[0] for r in rows if r[5] is not None and r[5] not in ("a", "b")],
        "t.ref.referential_integrity": [r[0] for r in rows if r[4] not in parents],
    }
    surplus = {}
    for check, a, b in (("t.names.uniqueness", 1, 2), ("t.days.uniqueness", 3, 4)):
        count = Counter((r[a], r[b]) for r in rows)
        failed[check] = [r[0] for r in rows if count[r[a], r[b]] > 1 and None not in (r[a], r[b])]
        least = {}
        for r in rows:
            least[r[a], r[b]] = min(least.get((r[a], r[b]), r[0]), r[0])
        surplus[check] = [r[0] for r in rows if r[0] != least[r[a], r[b]]]
    return failed, surplus


def same_everything(spark, rows):
    frames = {"t": spark.createDataFrame(rows, SCHEMA), "p": spark.createDataFrame([(1,), (2,), (2,), (None,)], "pid long")}
    failed, surplus = plain(rows, {1, 2})
    found = RowVerdicts(REG, frames, spark, readable_checks(REG, frames), POLICIES)
    assert {r.check_id: r.n_failed for r in found.counts().collect()} == {c: len(k) for c, k in failed.items()}
    targets = {}
    for row in found.targets().collect():
        targets.setdefault((row.check_id, row.action_id), []).append(row.key_n)
    for check, action in POLICIES:
        wanted = surplus[check] if action.startswith("dedupe") else failed[check]
        assert sorted(targets.get((check, action), [])) == sorted(wanted), (check, action)
    samples = suite.failure_samples(REG, frames, limit=3, verdicts=found).collect()
    for check, keys in failed.items():
        assert sorted(int(r.row_key) for r in samples if r.check_id == check) == sorted(keys)[:3], check
    names = ["name", "part"]
    assert sorted(r.id for r in checks.duplicate_rows(frames["t"], names).collect()) == sorted(failed["t.names.uniqueness"])
    assert sorted(r.id for r in remediation.surplus_rows(frames["t"], names, "id").collect()) == sorted(surplus["t.names.uniqueness"])
    return found


@pytest.mark.parametrize("small_parents", [True, False])
def test_verdicts_equal_plain(spark, request, small_parents):
    if not small_parents:
        request.getfixturevalue("no_broadcast")
    same_everything(spark, rows_like(80))


def test_forced_collisions(spark, monkeypatch):
    """All wide keys share one digest, or one of two; the keys themselves decide."""
    rows = rows_like(60, seed=4)
    monkeypatch.setattr(digests, "hash_pair", lambda keys: [F.lit(1).cast("long"), F.lit(1).cast("long")])
    same_everything(spark, rows)
    monkeypatch.setattr(digests, "hash_pair", lambda keys: [F.length(F.coalesce(F.col(keys[0]), F.lit(""))).cast("long"), F.lit(1).cast("long")])
    same_everything(spark, rows)


def test_digests_keep_nulls_apart(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, None, None), (4, "", "a"), (5, "a", "")], "id long, x string, y string")
    found = rows.select(*digests.digest_columns(["x", "y"], False)).distinct().count()
    assert found == 5
    numbers = spark.createDataFrame([(None, 1), (1, None), (0, 1), (42, 1), (None, None)], "x long, y int")
    assert digests.is_exact(numbers, ["x", "y"]) and numbers.select(*digests.digest_columns(["x", "y"], True)).distinct().count() == 5


def test_each_table_is_scanned_once_and_text_is_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame(rows_like(50), SCHEMA)
    rows.write.parquet(str(tmp_path / "t"))
    frames = {"t": spark.read.parquet(str(tmp_path / "t")), "p": spark.range(3).toDF("pid")}
    found = RowVerdicts(REG, frames, spark, readable_checks(REG, frames), POLICIES)
    for reading in (found.counts(), found.targets(), found.masks()):
        plan = reading._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path) not in plan  # facts and verdicts only
    tests = found.tests["t"]
    assert tests.place(("missing", "name")) == (0, 1)
    facts = found._facts_of(tests)._jdf.queryExecution().executedPlan().toString()
    assert facts.count("FileScan parquet") == 1 and "Exchange hashpartitioning" not in facts
    digested = frames["t"].select("id", *digests.digest_columns(["name", "part"], False)).groupBy(*digests.DIGEST).count()
    exchange = [line for line in digested._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchange and not any("name" in line for line in exchange)


def test_more_tests_than_bits_in_a_word(spark):
    columns = [{"name": "id", "dtype": "int64"}] + [{"name": f"c{n}", "dtype": "int64"} for n in range(130)]
    registry = Registry.from_document({
        "tables": [{"table": "w", "primary_key": ["id"], "columns": columns}],
        "checks": [{"check_id": f"w.c{n}", "table": "w", "column": f"c{n}", "dimension": "completeness",
                    "policies": [{"action_id": "quarantine_nulls"}]} for n in range(130)]})
    frame = spark.range(20).select("id", *[F.when(F.col("id") % (n + 2) != 0, F.col("id")).alias(f"c{n}") for n in range(130)])
    got = {r.check_id: r.n_failed for r in suite.run_suite(registry, {"w": frame}, spark).collect()}
    assert got == {f"w.c{n}": sum(k % (n + 2) == 0 for k in range(20)) for n in range(130)}


def test_repeated_null_and_text_keys(spark):
    rows = [(1, "x", None, None, 1, "c"), (1, None, None, None, 1, "a"), (None, "x", None, None, 1, "c"), (2, "x", None, None, 9, "c")]
    frames = {"t": spark.createDataFrame(rows, SCHEMA), "p": spark.createDataFrame([(1,)], "pid long")}
    samples = suite.failure_samples(REG, frames, ["t.kind.validity", "t.name.completeness"]).collect()
    assert sorted((r.check_id, r.row_key) for r in samples) == [
        ("t.kind.validity", ""), ("t.kind.validity", "1"), ("t.kind.validity", "2"), ("t.name.completeness", "1")]
    sets = {(r.check_id, r.action_id): r.target_count for r in remediation.target_sets(REG, frames, spark).collect()}
    assert sets[("t.kind.validity", "quarantine_invalids")] == 3
    assert ("t.names.uniqueness", "dedupe_keep_min_pk") not in sets  # which of the rows stays is open
    text = frames["t"].withColumn("id", F.concat(F.lit("k"), F.col("id").cast("string")))
    samples = suite.failure_samples(REG, {**frames, "t": text}, ["t.kind.validity"]).collect()
    assert sorted(r.row_key for r in samples) == ["", "k1", "k2"]


def test_samples_without_the_key_column(spark):
    frames = {"t": spark.createDataFrame(rows_like(30), SCHEMA).drop("id"), "p": spark.createDataFrame([(1,)], "pid long")}
    got = suite.failure_samples(REG, frames, ["t.kind.validity"], limit=2).collect()
    assert len(got) == 2 and [r.sample for r in got] == sorted(r.sample for r in got) and {r.row_key for r in got} == {""}
    assert remediation.target_sets(REG, frames, spark, [("t.kind.validity", "quarantine_invalids")]).count() == 0


def test_empty_tables(spark):
    frames = {"t": spark.createDataFrame([], SCHEMA), "p": spark.createDataFrame([], "pid long")}
    found = RowVerdicts(REG, frames, spark, readable_checks(REG, frames), POLICIES)
    assert all(r.n_failed == r.n_total == 0 for r in found.counts().collect()) and found.targets().count() == 0
    assert suite.failure_samples(REG, frames).count() == 0


def test_only_changed_files_are_read(spark, tmp_path):
    from rowwarden.operators import filesets

    root = str(tmp_path / "t")
    frame = spark.createDataFrame(rows_like(200), SCHEMA).withColumn("b", F.col("id") % 4)
    frame.repartition("b").write.partitionBy("b").parquet(root)
    policies = [("t.name.completeness", "quarantine_nulls"), ("t.kind.validity", "quarantine_invalids")]
    asked = []

    def read(paths):
        asked.append(sorted(paths))
        return filesets.parquet_files(spark, root)(paths)

    def total(sums):
        return sorted(map(tuple, filesets.total_sets(REG, "t", policies, sums).collect()))

    def plainly():
        return sorted(map(tuple, remediation.target_sets(
            REG, {"t": spark.read.parquet(root), "p": spark.range(1).toDF("pid")}, spark, policies).collect()))

    first = filesets.file_sets(REG, "t", policies, filesets.list_files(spark, root), read)
    assert total(first[1]) == plainly() and len(asked[0]) == 4
    again = filesets.file_sets(REG, "t", policies, filesets.list_files(spark, root), read, kept=first)
    assert len(asked) == 1 and total(again[1]) == plainly()
    part = stored(spark.read.parquet(root).filter("b = 2").withColumn("name", F.lit(None).cast("string")), "part")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b").parquet(root)
    more = spark.createDataFrame([(1000, None, None, None, None, "c")], SCHEMA).withColumn("b", F.lit(9))
    more.write.mode("append").partitionBy("b").parquet(root)
    later = filesets.file_sets(REG, "t", policies, filesets.list_files(spark, root), read, kept=first)
    assert total(later[1]) == plainly() and total(later[1]) != total(first[1])
    assert len(asked) == 2 and all("b=2" in path or "b=9" in path for path in asked[1])
    changed = filesets.changed_files(first[1], later[1]).collect()
    assert {row.path.split("b=")[1][0] for row in changed} == {"2", "9"}
    with pytest.raises(ValueError, match="other rows"):
        filesets.file_sets(REG, "t", [("t.ref.referential_integrity", "quarantine_orphans")], filesets.list_files(spark, root), read)
