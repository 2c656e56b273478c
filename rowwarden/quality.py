"""The quality job: run every check, record the run, return its sample-free summary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.operators import lineage, suite
from rowwarden.plans.compiler import short_id
from rowwarden.registry import Registry
from rowwarden.session import stored
from rowwarden.sources.sinks import Store


@dataclass(frozen=True)
class QualityReport:
    run_id: str
    report_id: str
    fingerprint: str
    audit_event_id: str
    exit_code: int
    outcome_summary: str
    incomplete: bool
    results: DataFrame


def run_quality_suite(
    registry: Registry, frames: Mapping[str, DataFrame], store: Store, run_id: str, at: datetime
) -> QualityReport:
    """Frames and store are both required, so a run is never left unrecorded.

    The results are stored once; check runs, report event and summary all read that table.
    Recording the same run again changes nothing.
    """
    results = stored(
        suite.run_suite(registry, frames, store.spark).withColumn("run_id", F.lit(run_id)), "results")
    summary = (
        suite.exit_category(suite.roll_up(results))
        .join(suite.report_fingerprints(results), "run_id")
        .withColumn("report_id", short_id(F.lit("report"), F.col("run_id"))))
    row = summary.head()
    event = lineage.report_events(summary)
    store.record_check_runs(results, row.report_id, at)
    store.append_events(event, at)
    return QualityReport(
        run_id, row.report_id, row.report_fingerprint, event.head().event_id, row.exit_code,
        row.outcome_summary, row.incomplete, suite.sample_free(results))
