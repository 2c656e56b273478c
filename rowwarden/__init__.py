"""Governed data quality on Spark: contracts, checks, remediation and audit as DataFrame jobs."""

from rowwarden.contracts import (
    ACTIONS,
    ActionRule,
    CheckPolicy,
    CheckSpec,
    ColumnContract,
    ContractError,
    TableContract,
)
from rowwarden.registry import Registry

__all__ = [
    "ACTIONS",
    "ActionRule",
    "CheckPolicy",
    "CheckSpec",
    "ColumnContract",
    "ContractError",
    "Registry",
    "TableContract",
]
