"""Durable tables of the engine, as Parquet below one root folder.

Every write is safe to repeat: events are recognised by id, and what an apply attempt stages
becomes visible only when a manifest of the apply log names its attempt and admission.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden.functions.fingerprint import row_hash, set_digest
from rowwarden.operators.lineage import EVENT_FIELDS
from rowwarden.session import config_frame, shuffles_dropped
from rowwarden.sources.tables import ABSENT

RUN_BUCKETS = 256
LOG_FIELDS = (
    "run_id string, action_id string, table_name string, plan_id string, admission_id string,"
    " item_id string, target_count bigint, target_fingerprint string, rowcount bigint,"
    " applied_at timestamp, event_id string, apply_result_id string, result_fingerprint string,"
    " admission_fingerprint string,"
    " steps array<struct<action_id:string,table:string,estimated_rows:bigint,rowcount:bigint>>, attempt string"
)
MANIFEST_SCHEMA = "version bigint, part string, n_entries bigint, n_files bigint, files_digest string"
EVENT_SCHEMA = ", ".join(
    ["event_id string", *[f"{n} {t}" for n, t in EVENT_FIELDS.items()], "fingerprint string",
     "occurred_at timestamp", "run_bucket int"])
QUARANTINE_SCHEMA = (
    "run_id string, table_name string, pk_json string, reason string, payload string,"
    " quarantined_at timestamp, pk_hash string, admission_id string, item_id string, attempt string")
# Target rows that many items share are stored once, as a set; an owner is an item that copied a set.
SET_SCHEMA = QUARANTINE_SCHEMA.replace("admission_id string, item_id string", "set_id string")
OWNER_SCHEMA = "set_id string, admission_id string, item_id string, attempt string"
COPY_TABLES = ("quarantine", "quarantine_sets", "quarantine_owners")
CHECK_RUN_SCHEMA = (
    "run_id string, report_id string, check_id string, contract_id string, status string,"
    " n_failed bigint, n_total bigint, recorded_at timestamp, run_bucket int")
CHECK_RUN_FIELDS = (
    "report_id", "check_id", "contract_id", "status", "n_failed", "n_total", "recorded_at")


def _bucket(run: str) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(RUN_BUCKETS)).cast("int")


@dataclass(frozen=True)
class Store:
    """Paths of the engine's tables. Commits rely on the file system's rename without overwriting, which
    HDFS and conditional object stores do atomically."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _append(self, rows: DataFrame, name: str, by: str) -> None:
        """Add rows to a table, packed as ids and digests need it; no shuffle files are left behind."""
        with shuffles_dropped(self.spark):
            rows.write.mode("append").option("compression", "zstd").partitionBy(by).parquet(self.path(name))

    def read(self, name: str, schema: str | T.StructType, form: str = "parquet") -> DataFrame:
        """A stored table, or an empty one before its first write."""
        try:
            return self.spark.read.schema(schema).format(form).load(self.path(name))
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith(ABSENT):
                raise
            return config_frame(self.spark, [], schema)

    # -- check runs ---------------------------------------------------------------------

    def record_check_runs(self, results: DataFrame, report_id: str, recorded_at) -> None:
        """One row per check without samples. Runs share a fixed number of buckets; recording a run
        again adds its rows, and readers take a run's last recording."""
        rows = results.withColumn("report_id", F.lit(report_id)).withColumn(
            "recorded_at", F.lit(recorded_at).cast("timestamp")).withColumn("run_bucket", _bucket("run_id"))
        (rows.select("run_id", *CHECK_RUN_FIELDS, "run_bucket").repartition("run_bucket").write.mode("append")
         .partitionBy("run_bucket").parquet(self.path("check_runs")))

    def check_runs(self) -> DataFrame:
        rows = self.read("check_runs", CHECK_RUN_SCHEMA)
        last = rows.groupBy("run_bucket", "run_id").agg(F.max("recorded_at").alias("recorded_at"))
        kept = rows.join(last, ["run_bucket", "run_id", "recorded_at"], "left_semi").drop("run_bucket")
        return kept.distinct()  # an attempt that was repeated wrote the same rows

    # -- audit events -------------------------------------------------------------------

    def append_events(self, events: DataFrame, occurred_at) -> None:
        self.append_events_at(events.withColumn("occurred_at", F.lit(occurred_at).cast("timestamp")))

    def append_events_at(self, events: DataFrame) -> None:
        """Add events (with ``occurred_at``) that are not stored yet. Only the run buckets of the new events are
        read to find out: the semi join on the partition column prunes the others."""
        keyed = events.dropDuplicates(["event_id"]).withColumn("run_bucket", _bucket("quality_run_id"))
        touched = keyed.select("run_bucket").distinct()
        stored = self.events().select("run_bucket", "event_id").join(
            F.broadcast(touched), "run_bucket", "left_semi")
        fresh = keyed.join(stored.select("event_id"), "event_id", "left_anti")
        self._append(fresh.select("event_id", *EVENT_FIELDS, "fingerprint", "occurred_at", "run_bucket").repartition("run_bucket"),
                     "audit_events", "run_bucket")

    def events(self) -> DataFrame:
        return self.read("audit_events", EVENT_SCHEMA)

    def export_jsonl(self, events: DataFrame, path: str) -> None:
        """Mirror of events: one JSON object with sorted keys per line."""
        names = sorted(name for name in events.columns if name != "run_bucket")
        events.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
                      ).write.mode("append").text(path)

    # -- quarantine and apply log --------------------------------------------------------

    def stage_copies(self, copies: DataFrame, attempt: str, at) -> DataFrame:
        """Write an attempt's copies (with admission_id and item_id) and return what was written.

        The written files are the pinned target sets: they are checked and committed as they are, without
        reading the source again. Attempts do not share files, so rivals cannot replace each other's.
        """
        self._stage(copies.withColumn("quarantined_at", F.lit(at).cast("timestamp")), attempt, "quarantine", QUARANTINE_SCHEMA)
        return self.staged_copies(attempt)

    def stage_sets(self, copies: DataFrame, attempt: str, at) -> None:
        """Write target rows (with set_id) once for all items that copy them: what an apply of many plans writes
        grows with the targets, not with targets times plans."""
        self._stage(copies.withColumn("quarantined_at", F.lit(at).cast("timestamp")), attempt, "quarantine_sets", SET_SCHEMA)

    def stage_owners(self, owners: DataFrame, attempt: str) -> None:
        """Write which items (admission_id, item_id) copied which sets (set_id) of an attempt."""
        self._stage(owners, attempt, "quarantine_owners", OWNER_SCHEMA)

    def _stage(self, rows: DataFrame, attempt: str, name: str, schema: str) -> None:
        names = [field.name for field in T.StructType.fromDDL(schema)]
        self._append(rows.withColumn("attempt", F.lit(attempt)).select(names), name, "attempt")

    def staged_sets(self, attempt: str) -> DataFrame:
        return self.read("quarantine_sets", SET_SCHEMA).filter(F.col("attempt") == attempt)

    def staged_copies(self, attempt: str) -> DataFrame:
        mine = F.col("attempt") == attempt
        return self._copies(self.read("quarantine", QUARANTINE_SCHEMA).filter(mine), self.read("quarantine_owners", OWNER_SCHEMA).filter(mine))

    def quarantine(self) -> DataFrame:
        """Committed copies only; what an attempt without a log entry staged is not visible. A row of a shared set
        stands here once for each item that copied it; ``copies_by_item`` sums up without that."""
        own, owners = (self._committed(self.read(name, schema)) for name, schema in (
            ("quarantine", QUARANTINE_SCHEMA), ("quarantine_owners", OWNER_SCHEMA)))
        return self._copies(own, owners).drop("attempt")

    def _copies(self, own: DataFrame, owners: DataFrame) -> DataFrame:
        shared = self.read("quarantine_sets", SET_SCHEMA).join(owners, ["attempt", "set_id"])
        return own.unionByName(shared.select(own.columns))

    def copies_by_item(self, *aggregates: Column) -> DataFrame:
        """(admission_id, item_id, aggregates) over the committed copies of each item. A shared set is summed up once
        and its sums are handed to every item that copied it."""
        own, owners = (self._committed(self.read(name, schema)) for name, schema in (
            ("quarantine", QUARANTINE_SCHEMA), ("quarantine_owners", OWNER_SCHEMA)))
        sums = self.read("quarantine_sets", SET_SCHEMA).groupBy("attempt", "set_id").agg(*aggregates)
        return own.groupBy("admission_id", "item_id").agg(*aggregates).unionByName(
            owners.join(sums, ["attempt", "set_id"]).drop("attempt", "set_id"))

    def stage_filled(self, filled: DataFrame, table: str, attempt: str) -> DataFrame:
        """Write an attempt's filled rows (with admission_id) and return what was written."""
        rows = filled.withColumn("attempt", F.lit(attempt))
        rows.write.mode("append").partitionBy("attempt").parquet(self.path(f"filled/{table}"))
        return self.read(f"filled/{table}", rows.schema).filter(F.col("attempt") == attempt)

    def filled(self, table: str) -> DataFrame | None:
        """Committed fills only, None before the first; the rows say which admission filled them."""
        try:
            rows = self.spark.read.parquet(self.path(f"filled/{table}"))
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith(ABSENT):
                raise
            return None
        return self._committed(rows).drop("attempt")

    def _committed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.apply_log().select("attempt", "admission_id").distinct(), ["attempt", "admission_id"], "left_semi")

    def manifests(self) -> DataFrame:
        """One row per commit: its version, the part of the log that it made visible, and the number
        and digest of the files it covers."""
        return self.read("apply_log/commits", MANIFEST_SCHEMA, "json")

    def apply_log(self) -> DataFrame:
        visible = self.manifests().select("part").distinct()
        return self.read("apply_log/rows", f"{LOG_FIELDS}, part string").join(visible, "part", "left_semi").drop("part")

    def append_log(self, entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """Commit: make log entries visible, all at once, and return those that were.

        An admission is committed once: entries whose admission has one already are left out. The entries
        carry the result evidence and are written first; the commit is the exclusive creation of the next
        manifest. Whoever loses that race looks at the log again before the next version. A blank admission is
        never in the way of another."""
        todo = entries
        while True:
            version = 1 + (self.manifests().agg(F.max("version")).head()[0] or 0)
            named = F.coalesce(F.trim("admission_id"), F.lit("")) != ""
            taken = self.apply_log().filter(named).select("admission_id").distinct()
            part = uuid.uuid4().hex
            fresh = todo.join(taken, "admission_id", "left_anti").select(
                *[field.name for field in T.StructType.fromDDL(LOG_FIELDS)], F.lit(part).alias("part"))
            self._append(fresh, "apply_log/rows", "part")
            todo = self.read("apply_log/rows", f"{LOG_FIELDS}, part string").filter(F.col("part") == part).drop("part")
            counted = todo.agg(F.count(F.lit(1)).alias("n_entries")).head()
            if not counted.n_entries:
                return todo
            covered = files.agg(F.count(F.lit(1)).alias("n"), set_digest("file_hash", "files").alias("digest")).head() if files is not None else None
            manifest = {"version": version, "part": part, "n_entries": counted.n_entries,
                        "n_files": covered.n if covered else 0, "files_digest": covered.digest if covered else None}
            if self._create(f"apply_log/commits/{version:012d}.json", json.dumps(manifest)):
                return todo

    def files_of(self, attempt: str, *names: str) -> DataFrame:
        """(path, length, file_hash) of the files an attempt staged; contents are not read."""
        parts = [config_frame(self.spark, [], "path string, length bigint")]
        for name in names:
            try:
                found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path(name)}/attempt={attempt}")
            except AnalysisException as exc:
                if not (exc.getCondition() or "").startswith(ABSENT):
                    raise
                continue
            parts.append(found.select("path", "length"))
        return reduce(DataFrame.unionByName, parts).select(
            "*", row_hash(F.concat_ws("|", "path", F.col("length").cast("string"))).alias("file_hash"))

    def _create(self, name: str, text: str) -> bool:
        """Create a file with its content unless it exists. It is written aside and renamed without overwriting,
        so a reader sees all of it or nothing, and of two creators one fails."""
        hadoop = self.spark._jvm.org.apache.hadoop
        path = hadoop.fs.Path(self.path(name))
        aside = hadoop.fs.Path(self.path(f"apply_log/aside/{uuid.uuid4().hex}"))
        context = hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(path.getParent())
        out = system.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            context.rename(aside, path, self.spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as exc:
            if exc.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            system.delete(aside, False)
            return False
        return True
