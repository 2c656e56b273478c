"""Typed conformance: does every value fit its contract type, nullability and range?

Separate from the suite, which compares names only. One aggregation per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.contracts import DTYPES


@dataclass(frozen=True)
class FieldRule:
    """``dtype`` from the contract vocabulary, then optional bounds on the coerced value."""

    column: str
    dtype: str
    nullable: bool = False
    isin: Sequence[str] | None = None
    ge: float | None = None
    gt: float | None = None
    le: float | None = None


def violations(rule: FieldRule) -> dict[str, Column]:
    """Named conditions a violating row satisfies; ranges look at the coerced value."""
    raw = F.col(rule.column)
    value = raw.try_cast(DTYPES[rule.dtype])
    found = {"coercible": raw.isNotNull() & value.isNull()}
    if not rule.nullable:
        found["not_null"] = raw.isNull()
    if rule.isin is not None:
        found["isin"] = ~value.isin(*rule.isin)
    if rule.ge is not None:
        found["ge"] = value < rule.ge
    if rule.gt is not None:
        found["gt"] = value <= rule.gt
    if rule.le is not None:
        found["le"] = value > rule.le
    return found


def conformance(rows: DataFrame, table: str, rules: Sequence[FieldRule]) -> DataFrame:
    """(table, column, rule, n_failed, n_total), one row per declared rule. A contracted column
    that is absent violates ``present`` with every row; extra columns are allowed."""
    tests: list[tuple[str, str, Column]] = []
    for rule in rules:
        if rule.column not in rows.columns:
            tests.append((rule.column, "present", F.lit(True)))
            continue
        tests += [(rule.column, name, test) for name, test in violations(rule).items()]
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(test).alias(f"f{n}") for n, (_, _, test) in enumerate(tests)],
    )
    entries = [
        F.struct(F.lit(column).alias("column"), F.lit(name).alias("rule"),
                 F.col(f"f{n}").alias("n_failed"))
        for n, (column, name, _) in enumerate(tests)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("r"), "n_total").select(
        F.lit(table).alias("table"), "r.column", "r.rule", "r.n_failed", "n_total"
    )


def conformance_of(frames: Mapping[str, DataFrame],
                   rules: Mapping[str, Sequence[FieldRule]]) -> DataFrame:
    """All tables together; each is scanned once for the columns its rules name."""
    parts = [conformance(frames[table], table, declared) for table, declared in rules.items()
             if table in frames]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
