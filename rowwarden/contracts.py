"""Table contracts, check specs and action rules: the declared side of every check.

These are small, immutable records. They live on the driver, are validated once when a
registry is built, and reach the executors only as Column expressions or as config
DataFrames (see ``registry.py``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from pyspark.sql import types as T

# The contract vocabulary.
DTYPES = MappingProxyType(
    {
        "int64": T.LongType(),
        "float64": T.DoubleType(),
        "utf8": T.StringType(),
        "date": T.DateType(),
        "datetime": T.TimestampType(),
        "bool": T.BooleanType(),
    }
)
COMPLETENESS = "completeness"
VALIDITY = "validity"
UNIQUENESS = "uniqueness"
SCHEMA_DRIFT = "schema_drift"
REFERENTIAL_INTEGRITY = "referential_integrity"
DIMENSIONS = (COMPLETENESS, VALIDITY, UNIQUENESS, SCHEMA_DRIFT, REFERENTIAL_INTEGRITY)
PASS, FAIL, ERROR = "pass", "fail", "error"
DESTRUCTIVE_RANKS = MappingProxyType(
    {"none": 0.0, "low": 0.15, "medium": 0.4, "high": 0.75, "critical": 1.0}
)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# Characters a ``contains`` needle may not hold, so the rule stays portable to SQL LIKE.
LIKE_SPECIAL = frozenset("%_\\'")


class ContractError(ValueError):
    """A declaration is refused; ``path`` names the offending field inside it."""

    def __init__(self, message: str, path: str = "") -> None:
        super().__init__(message)
        self.path = path


def identifier(value: object, path: str) -> str:
    if not isinstance(value, str) or not IDENTIFIER.fullmatch(value):
        raise ContractError(f"invalid identifier {value!r}", path)
    return value


def bare_name(table: str) -> str:
    """Tables are looked up by bare name; ``warehouse.orders`` and ``orders`` are one table."""
    return table.rsplit(".", 1)[-1]


# The fields of the declarations below are the vocabulary of registry documents.
@dataclass(frozen=True)
class ColumnContract:
    """``nullable`` and ``unique`` document the column; only checks enforce anything."""

    name: str
    dtype: str
    nullable: bool = False
    unique: bool = False
    allowed_values: tuple[str, ...] | None = None
    description: str = ""

    def __post_init__(self) -> None:
        identifier(self.name, "name")
        if self.dtype not in DTYPES:
            raise ContractError(f"dtype must be one of {', '.join(DTYPES)}", "dtype")


@dataclass(frozen=True)
class TableContract:
    table: str
    columns: tuple[ColumnContract, ...]
    primary_key: tuple[str, ...]
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    schema_name: str = "warehouse"
    grain: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        identifier(self.table, "table")
        identifier(self.schema_name, "schema_name")
        for position, name in enumerate(self.primary_key):
            identifier(name, f"primary_key.{position}")
        for position, key in enumerate(self.foreign_keys):
            if len(key) != 3:
                raise ContractError("needs (column, ref_table, ref_column)", f"foreign_keys.{position}")
            for part in key:
                identifier(part, f"foreign_keys.{position}")

    @property
    def contract_id(self) -> str:
        return f"{self.schema_name}.{self.table}"

    @property
    def column_names(self) -> list[str]:
        return [column.name for column in self.columns]

    @property
    def single_key(self) -> str | None:
        return self.primary_key[0] if len(self.primary_key) == 1 else None

    def column(self, name: str) -> ColumnContract | None:
        return next((column for column in self.columns if column.name == name), None)

    def foreign_key(self, column: str | None) -> tuple[str, str, str] | None:
        return next((key for key in self.foreign_keys if key[0] == column), None)


@dataclass(frozen=True)
class CheckPolicy:
    """One remediation a check permits. The first declared policy is the default proposal."""

    action_id: str
    parameters: MappingProxyType[str, Any] = field(default_factory=lambda: MappingProxyType({}))


@dataclass(frozen=True)
class CheckSpec:
    check_id: str
    table: str
    dimension: str
    description: str = ""
    column: str | None = None
    contract_id: str = ""
    policies: tuple[CheckPolicy, ...] = ()
    contains: str | None = None
    window_start_column: str | None = None
    window_end_column: str | None = None
    business_key: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.check_id:
            raise ContractError("check_id must not be empty", "check_id")
        if self.dimension not in DIMENSIONS:
            raise ContractError(f"dimension must be one of {', '.join(DIMENSIONS)}", "dimension")
        for name in ("column", "window_start_column", "window_end_column"):
            if getattr(self, name) is not None:
                identifier(getattr(self, name), name)
        for position, name in enumerate(self.business_key):
            identifier(name, f"business_key.{position}")

    @property
    def has_window(self) -> bool:
        return self.window_start_column is not None and self.window_end_column is not None

    def policy(self, action_id: str) -> CheckPolicy | None:
        return next((rule for rule in self.policies if rule.action_id == action_id), None)


@dataclass(frozen=True)
class ActionRule:
    """What one allow-listed action needs and does.

    ``derives`` names parameters that come from the check and its contract; ``given`` names
    those the policy must state. Nothing else is accepted.
    """

    action_id: str
    mutates: bool
    rank: str
    reversible: bool
    derives: tuple[str, ...]
    given: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return self.derives + self.given


# The seven governed actions and their published metadata.
ACTIONS = MappingProxyType(
    {
        rule.action_id: rule
        for rule in (
            ActionRule("no_op_alert", False, "none", True, ("check_id",)),
            ActionRule("quarantine_nulls", True, "medium", True, ("column", "pk_column")),
            ActionRule("quarantine_invalids", True, "medium", True, ("check_id", "column", "pk_column")),
            ActionRule("null_fill", True, "low", False, ("column",), ("fill_value",)),
            ActionRule(
                "quarantine_orphans", True, "medium", True,
                ("fk_column", "ref_table", "ref_column", "pk_column"),
            ),
            ActionRule("dedupe_keep_min_pk", True, "high", True, ("pk_column",), ("business_key",)),
            ActionRule("schema_drift_ticket", False, "none", True, ("check_id",)),
        )
    }
)
