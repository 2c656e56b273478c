"""Typed constants for ``null_fill`` and typed conformance rules."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden.contracts import DTYPES, ColumnContract, ContractError

_PLAIN = {"int64": (int,), "float64": (int, float), "utf8": (str,), "bool": (bool,)}
# a decimal number without a type letter, nothing around it
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_ISO = {"date": date, "datetime": datetime}


def fill_value(column: ColumnContract, value: Any) -> Any:
    """The constant a null is replaced with, or a refusal when it does not fit the contract."""
    dtype = column.dtype
    refusal = ContractError(f"{column.name} requires a {dtype} fill_value", "fill_value")
    if dtype in _PLAIN:
        # bool is a Python int, but a flag is never a number here.
        if not isinstance(value, _PLAIN[dtype]) or (isinstance(value, bool) != (dtype == "bool")):
            raise refusal
        return float(value) if dtype == "float64" else value
    if isinstance(value, str):
        try:
            return _ISO[dtype].fromisoformat(value)
        except ValueError:
            raise refusal from None
    if not isinstance(value, _ISO[dtype]) or (dtype == "date" and isinstance(value, datetime)):
        raise refusal
    return value


def fill_literal(column: ColumnContract, value: Any) -> Column:
    return F.lit(fill_value(column, value)).cast(DTYPES[column.dtype])


def fits_dtype(raw: Column, dtype: Column) -> Column:
    """Row form of ``fill_value`` for a table of textual values: does ``raw`` parse as ``dtype``?"""
    parsed = F.when(F.lit(False), F.lit(False))
    for name in DTYPES:
        if name == "utf8":
            ok = raw.isNotNull()
        elif name == "date":
            # an ISO date and nothing after it: a datetime is refused for a date
            ok = raw.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & raw.try_cast("date").isNotNull()
        elif name == "datetime":
            ok = raw.rlike(r"\A\d{4}-\d{2}-\d{2}") & raw.try_cast("timestamp_ntz").isNotNull()
        elif name == "bool":
            ok = raw.isin("true", "false")
        elif name == "int64":
            ok = raw.rlike(r"\A[+-]?\d+\z") & raw.try_cast("bigint").isNotNull()
        else:
            ok = raw.rlike(NUMBER) & raw.try_cast("double").isNotNull()
        parsed = parsed.when(dtype == name, F.coalesce(ok, F.lit(False)))
    return F.coalesce(parsed, F.lit(False))
