"""Fingerprints.

Two forms. ``struct_digest`` hashes one bounded record: the canonical compact JSON of a
struct. ``set_digest`` hashes an unbounded set of rows without ordering or collecting them:
every row is hashed with SHA-256, all 256 bits of the hash are cut into five lanes, and each lane
is summed. Sums are partial aggregates, so only one small row per task and set is shuffled, and any number
of sets can share one scan. Two sets get the same digest exactly when their row counts and all
five sums agree.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "sha256:"
# (first hex digit, digits) of each lane: together the whole hash. A lane is below 2**52 and
# decimal(18,0) sums into decimal(28,0), enough for 10**12 rows; beyond that Spark raises.
LANES = ((1, 13), (14, 13), (27, 13), (40, 13), (53, 12))
LANE_TYPE = "decimal(18,0)"


def json_digest(value: Any) -> str:
    """Driver-side digest of config: sorted keys, compact separators, ASCII."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return PREFIX + hashlib.sha256(text.encode()).hexdigest()


def text_digest(text: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(text.cast("binary"), 256))


def struct_digest(*columns: Column) -> Column:
    """Digest of one record; nulls are kept so that a missing value differs from no field."""
    return text_digest(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def row_hash(row_key: Column) -> Column:
    """Hash of one row's key as 64 hex digits; a null key has a hash of its own. Project it before
    aggregating, so that it is computed once per row."""
    tagged = F.coalesce(F.concat(F.lit("k"), row_key.cast("string")), F.lit("n"))
    return F.sha2(tagged.cast("binary"), 256)


def _lane_sums(hashed: str) -> list[str]:
    """SQL for the lane sums of a hash column; null hashes are left out."""
    return [
        f"coalesce(sum(cast(cast(conv(substring({hashed}, {first}, {digits}), 16, 10) as bigint) as {LANE_TYPE})), 0)"
        for first, digits in LANES
    ]


def _fold(label: str, count: str, lanes: list[str]) -> Column:
    parts = ", ".join(f"cast({part} as string)" for part in (label, count, *lanes))
    return F.expr(f"concat('{PREFIX}', sha2(cast(concat_ws('|', {parts}) as binary), 256))")


def set_digest(hashed: str, label: str | None = None, column: str | None = None) -> Column:
    """Aggregate expression: the digest of all non-null row hashes of a group.

    ``hashed`` names the hash column; the label is a plain word, or SQL over grouping columns.
    """
    return _fold(f"'{label}'" if column is None else column, f"count({hashed})", _lane_sums(hashed))


def empty_set_digest(label: str | None = None, column: str | None = None) -> Column:
    """The digest of no rows, for a fixed label or for the label in a column."""
    return _fold(f"'{label}'" if column is None else column, "0", ["0"] * len(LANES))


def set_digest_of(label: str, count: str, lanes: list[str]) -> Column:
    """The digest of a set whose row count and lane sums are known; all are SQL expressions."""
    return _fold(label, count, lanes)
