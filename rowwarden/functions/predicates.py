"""Row rules, each defined once as a Column.

Counts, samples, target sets and quarantine copies are all projections of these columns, so
a rule cannot mean one thing in the suite and another in a remediation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden.contracts import (
    COMPLETENESS,
    REFERENTIAL_INTEGRITY,
    SCHEMA_DRIFT,
    VALIDITY,
    CheckSpec,
)
from rowwarden.registry import Registry

MESSAGE_LIMIT = 200  # fixed value: longest structural error text


def is_missing(column: str) -> Column:
    """NaN and the empty string are values, not gaps."""
    return F.col(column).isNull()


def outside_allowed(column: str, allowed: Sequence[str]) -> Column:
    """Unknown for null, so a null row is not kept by a filter or counted by ``count_if``."""
    return ~F.col(column).isin(*allowed)


def lacks_text(column: str, needle: str) -> Column:
    """Null has no text at all and therefore fails."""
    return ~F.coalesce(F.col(column).contains(needle), F.lit(False))


def outside_window(column: str, start: str, end: str) -> Column:
    """Bounds are inclusive; a null bound leaves only that side unknown."""
    value = F.col(column)
    return value.isNotNull() & ((value < F.col(start)) | (value > F.col(end)))


def row_predicate(registry: Registry, spec: CheckSpec) -> Column | None:
    """The failing-row condition of a completeness or validity check, else None."""
    if spec.dimension == COMPLETENESS:
        return is_missing(spec.column)
    if spec.dimension != VALIDITY:
        return None
    if spec.contains is not None:
        return lacks_text(spec.column, spec.contains)
    if spec.has_window:
        return outside_window(spec.column, spec.window_start_column, spec.window_end_column)
    return outside_allowed(spec.column, registry.contract(spec.table).column(spec.column).allowed_values)


def rule_columns(spec: CheckSpec) -> list[str]:
    """Columns a check reads on its own table, each once, in declaration order."""
    named = [spec.column, *spec.business_key, spec.window_start_column, spec.window_end_column]
    return list(dict.fromkeys(name for name in named if name is not None))


def structural_error(
    registry: Registry, spec: CheckSpec, observed: Mapping[str, Sequence[str]]
) -> str | None:
    """Why the check cannot be planned against the observed schemas, or None.

    Decided from schemas alone, before any plan exists, so a defect in a rule is never
    mistaken for a missing column. Drift checks report missing structure themselves.
    """
    if spec.dimension == SCHEMA_DRIFT:
        return None
    needs = [(spec.table, rule_columns(spec))]
    if spec.dimension == REFERENTIAL_INTEGRITY:
        contract = registry.contract(spec.table)
        _, parent, parent_column = contract.foreign_key(spec.column)
        needs[0][1].extend(contract.primary_key)
        needs.append((parent, [parent_column]))
    for table, columns in needs:
        gap = None
        if table not in observed:
            gap = f"missing table {table}"
        else:
            absent = [name for name in columns if name not in observed[table]]
            if absent:
                gap = f"missing column {absent[0]} on {table}"
        if gap:
            return f"cannot evaluate {spec.check_id}: {gap}"[:MESSAGE_LIMIT]
    return None
