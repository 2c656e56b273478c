"""Target sets by file, so that a recheck reads changed files only.

A target set's digest is a sum over rows, so it is also a sum over files. The sums of every file are
kept with its path, size and time of change. A recheck lists the table's files, reads those that are
new or differ, and adds the kept sums of the others; it can also say in which files a target set
changed. This holds for policies whose targets each row decides alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.functions.fingerprint import LANE_TYPE, LANES, row_hash, set_digest_of
from rowwarden.operators.remediation import row_condition
from rowwarden.registry import Registry
from rowwarden.session import config_frame, stored

FILE = ("path", "length", "changed_at")
LANE_NAMES = tuple(f"lane{n}" for n in range(len(LANES)))
POLICY = ("check_id", "action_id")
# (paths) -> the contracted rows of these files, with ``file_path``
Reader = Callable[[Sequence[str]], DataFrame]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``FILE`` of the data files below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select(
        "path", "length", F.col("modificationTime").alias("changed_at"))


def parquet_files(spark: SparkSession, root: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Reader:
    """A reader of files below ``root``; ``shape`` turns what is stored into the contracted columns and keeps ``file_path``."""
    def read(paths: Sequence[str]) -> DataFrame:
        rows = spark.read.option("basePath", root).parquet(*paths)
        return shape(rows.withColumn("file_path", F.col("_metadata.file_path")))
    return read


def _sums(registry: Registry, table: str, policies: Sequence[tuple[str, str]], rows: DataFrame) -> DataFrame:
    """(path, check_id, action_id, n, lanes) of the files that hold target rows. One scan for all policies."""
    hits = [F.when(row_condition(registry, *policy), F.struct(*[F.lit(value).alias(name) for name, value in zip(POLICY, policy, strict=True)]))
            for policy in policies]
    pk = registry.contract(table).single_key
    hashed = rows.select("file_path", F.explode(F.array_compact(F.array(*hits))).alias("policy"), F.col(pk).alias("pk")).select(
        F.col("file_path").alias("path"), "policy.*", row_hash(F.col("pk")).alias("hashed"))
    lanes = [F.expr(f"sum(cast(conv(substring(hashed, {first}, {digits}), 16, 10) as {LANE_TYPE}))").alias(name)
             for name, (first, digits) in zip(LANE_NAMES, LANES, strict=True)]
    return hashed.groupBy("path", *POLICY).agg(F.count("hashed").alias("n"), *lanes)


def file_sets(registry: Registry, table: str, policies: Iterable[tuple[str, str]], files: DataFrame, read: Reader,
              kept: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The files (``FILE``) and their target sums (path, check_id, action_id, n, lanes), both stored.

    ``kept`` are the results of an earlier call: files that are the same since are not read. The names of files
    to read go through the driver, as for any read of a path list."""
    policies = list(policies)
    for policy in policies:
        if row_condition(registry, *policy) is None:
            raise ValueError(f"{'/'.join(policy)}: its targets depend on other rows")
    spark = files.sparkSession
    now = stored(files.select(*FILE), "files")
    todo = now if kept is None else now.join(kept[0], list(FILE), "left_anti")
    paths = [row["path"] for row in todo.select("path").collect()]
    parts = []
    if paths:
        parts.append(_sums(registry, table, policies, read(paths)))
    if kept is not None:
        parts.append(kept[1].join(now.join(kept[0], list(FILE), "left_semi").select("path"), "path", "left_semi"))
    if not parts:
        parts.append(config_frame(spark, [], "path string, check_id string, action_id string, n bigint, "
                                  + ", ".join(f"{name} decimal(28,0)" for name in LANE_NAMES)))
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return now, stored(sums, "file_sets")


def total_sets(registry: Registry, table: str, policies: Iterable[tuple[str, str]], sums: DataFrame) -> DataFrame:
    """(check_id, action_id, table, target_count, target_fingerprint), as ``target_sets`` gives them."""
    asked = config_frame(sums.sparkSession, list(policies), "check_id string, action_id string")
    added = sums.groupBy(*POLICY).agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in LANE_NAMES])
    return asked.join(added, list(POLICY), "left").select(
        *POLICY, F.lit(table).alias("table"), F.coalesce("n", F.lit(0)).alias("target_count"),
        set_digest_of(f"concat('{table}|', action_id)", "coalesce(n, 0)", [f"coalesce({name}, 0)" for name in LANE_NAMES]).alias("target_fingerprint"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, check_id, action_id, n_before, n_after): where the target sets differ. A file that is gone
    has no targets any more, a new one had none."""
    names = ["n", *LANE_NAMES]
    sides = [frame.select("path", *POLICY, *[F.col(name).alias(f"{side}_{name}") for name in names])
             for side, frame in (("before", before), ("after", after))]
    joined = sides[0].join(sides[1], ["path", *POLICY], "full_outer")
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"before_{name}").eqNullSafe(F.col(f"after_{name}"))
    return joined.filter(~same).select(
        "path", *POLICY, F.coalesce("before_n", F.lit(0)).alias("n_before"), F.coalesce("after_n", F.lit(0)).alias("n_after"))
