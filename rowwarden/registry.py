"""The registry: every declared contract and check, validated as a whole.

A registry is plain driver-side config. ``*_frame`` methods publish it as small DataFrames
whose size is the number of declarations, never the number of rows scanned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import fields, replace
from datetime import date
from pathlib import Path
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowwarden.contracts import (
    ACTIONS,
    DESTRUCTIVE_RANKS,
    LIKE_SPECIAL,
    REFERENTIAL_INTEGRITY,
    SCHEMA_DRIFT,
    UNIQUENESS,
    VALIDITY,
    CheckPolicy,
    CheckSpec,
    ColumnContract,
    ContractError,
    TableContract,
    bare_name,
)
from rowwarden.functions.fingerprint import json_digest
from rowwarden.functions.values import fill_value
from rowwarden.session import config_frame

# Version of the rules that turn a policy into target rows; part of every policy fingerprint.
RULES_VERSION = "rowwarden-rules-1"


class Registry:
    """Contracts by bare table name and checks by id, both in declaration order.

    ``action_tables`` maps an action id to the tables it may touch; an action that is not
    listed may touch any contracted table.
    """

    def __init__(self, action_tables: Mapping[str, Iterable[str]] | None = None) -> None:
        self.contracts: dict[str, TableContract] = {}
        self.checks: dict[str, CheckSpec] = {}
        self.action_tables = {
            action: frozenset(tables) for action, tables in (action_tables or {}).items()
        }

    # -- registration -----------------------------------------------------------------

    def register_contract(self, contract: TableContract) -> None:
        if contract.table in self.contracts:
            raise ContractError(f"table {contract.table!r} is already registered", "table")
        self.contracts[contract.table] = contract

    def register_check(self, spec: CheckSpec) -> CheckSpec:
        """Validate the spec and every policy it declares before it becomes visible."""
        if spec.check_id in self.checks:
            raise ContractError(f"check_id {spec.check_id!r} is already registered", "check_id")
        contract = self._contract_or_refuse(spec.table, "table")
        spec = replace(
            spec, table=contract.table, contract_id=spec.contract_id or contract.contract_id
        )
        self._require_evaluable(spec, contract)
        for position, policy in enumerate(spec.policies):
            try:
                self.policy_params(spec, policy.action_id)
            except ContractError as exc:
                tail = f".{exc.path}" if exc.path else ""
                raise ContractError(str(exc), f"policies.{position}{tail}") from None
        self.checks[spec.check_id] = spec
        return spec

    def contract(self, table: str) -> TableContract:
        return self.contracts[bare_name(table)]

    def check(self, check_id: str) -> CheckSpec:
        return self.checks[check_id]

    def tables_of(self, *check_ids: str) -> list[str]:
        """The tables a few checks read: their own and those their foreign keys refer to."""
        tables: list[str] = []
        for check_id in check_ids:
            spec = self.check(check_id)
            key = self.contract(spec.table).foreign_key(spec.column)
            tables.append(spec.table)
            if key and spec.dimension == REFERENTIAL_INTEGRITY:
                tables.append(key[1])
        return list(dict.fromkeys(tables))

    def _contract_or_refuse(self, table: str, path: str) -> TableContract:
        try:
            return self.contract(table)
        except KeyError:
            raise ContractError(f"unknown table {table!r}", path) from None

    @staticmethod
    def _require_evaluable(spec: CheckSpec, contract: TableContract) -> None:
        if spec.dimension == SCHEMA_DRIFT:
            return
        if contract.single_key is None:
            raise ContractError(f"{contract.table} does not have a single-column primary key")
        if spec.dimension == UNIQUENESS:
            if not spec.business_key:
                raise ContractError("a uniqueness check must declare a business_key", "business_key")
            return
        if spec.column is None:
            raise ContractError(f"a {spec.dimension} check must name a column", "column")
        if spec.dimension == REFERENTIAL_INTEGRITY and not contract.foreign_key(spec.column):
            raise ContractError("column is not a contracted foreign key", "column")
        if spec.dimension == VALIDITY:
            if spec.contains is not None:
                if LIKE_SPECIAL & set(spec.contains):
                    raise ContractError("needle may not hold % _ \\ or a quote", "contains")
            elif not spec.has_window:
                declared = contract.column(spec.column)
                if declared is None or not declared.allowed_values:
                    raise ContractError("no validity rule: contains, window or allowed_values", "column")

    # -- remediation policies -----------------------------------------------------------

    def policy_params(self, spec: CheckSpec, action_id: str) -> dict[str, Any]:
        """Parameters of one declared policy: stated ones plus those the contract supplies."""
        rule = ACTIONS.get(action_id)
        if rule is None:
            raise ContractError(f"unknown action_id {action_id!r}", "action_id")
        policy = spec.policy(action_id)
        if policy is None:
            raise ContractError("requested action is not declared by the check policy", "action_id")
        contract = self.contract(spec.table)
        key = contract.foreign_key(spec.column) or (None, None, None)
        available = {
            "check_id": spec.check_id,
            "column": spec.column,
            "pk_column": contract.single_key,
            "fk_column": key[0],
            "ref_table": key[1],
            "ref_column": key[2],
        }
        params = {**policy.parameters, **{name: available[name] for name in rule.derives}}
        errors = self.param_errors(spec.table, action_id, params, pending=spec)
        if errors:
            raise ContractError("; ".join(errors), "parameters")
        return params

    def param_errors(
        self,
        table: str,
        action_id: str,
        params: Mapping[str, Any],
        pending: CheckSpec | None = None,
    ) -> list[str]:
        """Every reason ``params`` cannot drive ``action_id`` on ``table``; empty when bindable.

        ``pending`` is a check that is being registered and not visible yet.
        """
        rule = ACTIONS[action_id]
        allowed = self.action_tables.get(action_id)
        if allowed is not None and bare_name(table) not in allowed:
            return [f"{action_id} is not allowed on {bare_name(table)}"]
        contract = self.contracts.get(bare_name(table))
        if contract is None:
            return [f"unknown table {table!r}"]
        errors = [f"missing param {name}" for name in rule.required if params.get(name) is None]
        errors += [f"unexpected param {name}" for name in sorted(set(params) - set(rule.required))]
        if errors:
            return errors
        keys = params.get("business_key", ())
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        if "business_key" in rule.required and not keys:
            errors.append("business_key must name at least one column")
        own = [params[name] for name in ("column", "fk_column", "pk_column") if name in params]
        for name in (*own, *keys):
            if not isinstance(name, str) or contract.column(name) is None:
                errors.append(f"{name!r} is not a column on {contract.table}")
        if "pk_column" in params and params["pk_column"] not in contract.primary_key:
            errors.append("pk_column must be the contracted primary key")
        if "ref_table" in params:
            triple = (params["fk_column"], params["ref_table"], params["ref_column"])
            if triple not in contract.foreign_keys:
                errors.append("fk_column, ref_table and ref_column must be a contracted foreign key")
            parent = self.contracts.get(bare_name(str(params["ref_table"])))
            if parent is None or parent.column(params["ref_column"]) is None:
                errors.append("ref_table and ref_column must be contracted")
        if action_id == "quarantine_invalids":
            named = self.checks.get(params["check_id"])
            if named is None and pending is not None and pending.check_id == params["check_id"]:
                named = pending
            errors += self._invalid_rule_errors(contract, params, named)
        if action_id == "null_fill" and contract.column(params["column"]):
            try:
                fill_value(contract.column(params["column"]), params["fill_value"])
            except ContractError as exc:
                errors.append(str(exc))
        return errors

    @staticmethod
    def _invalid_rule_errors(
        contract: TableContract, params: Mapping[str, Any], spec: CheckSpec | None
    ) -> list[str]:
        if spec is None:
            return ["check_id must name a declared check"]
        errors = []
        if spec.table != contract.table:
            errors.append(f"check {spec.check_id} is not defined for {contract.table}")
        if spec.dimension != VALIDITY:
            errors.append(f"check {spec.check_id} is not a validity check")
        if params["column"] != spec.column:
            errors.append("column must be the column of the check")
        return errors

    # -- loading -----------------------------------------------------------------------

    def load(self, path: str | Path) -> Registry:
        """Add one YAML or JSON document; on any error nothing of it is kept."""
        source = Path(path)
        staged = Registry(self.action_tables)
        staged.contracts.update(self.contracts)
        staged.checks.update(self.checks)
        staged._add_document(_read_document(source), source)
        self.contracts, self.checks = staged.contracts, staged.checks
        self.action_tables = staged.action_tables
        return self

    @classmethod
    def from_file(cls, path: str | Path) -> Registry:
        """A registry holding exactly one document."""
        return cls().load(path)

    @classmethod
    def from_document(cls, document: Mapping[str, Any], name: str = "document") -> Registry:
        registry = cls()
        registry._add_document(document, Path(name))
        return registry

    def _add_document(self, document: Mapping[str, Any], source: Path) -> None:
        unknown = set(document) - {"tables", "checks", "action_tables"}
        if unknown:
            raise ContractError(f"{source}: {sorted(unknown)[0]}: unknown field")
        for action, tables in (document.get("action_tables") or {}).items():
            if action not in ACTIONS:
                raise ContractError(f"{source}: action_tables.{action}: unknown action")
            self.action_tables[action] = frozenset(tables)
        for section, build, register in (
            ("tables", _table_from, self.register_contract),
            ("checks", _check_from, self.register_check),
        ):
            for position, raw in enumerate(document.get(section) or []):
                try:
                    register(build(raw))
                except ContractError as exc:
                    where = f"{section}.{position}" + (f".{exc.path}" if exc.path else "")
                    raise ContractError(f"{source}: {where}: {exc}") from None

    # -- config frames (sized by the number of declarations) ------------------------------

    def tables_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.table, c.contract_id, c.grain, c.description, list(c.primary_key))
            for c in self.contracts.values()
        ]
        return config_frame(
            spark,
            rows,
            "table string, contract_id string, grain string, description string,"
            " primary_key array<string>",
        )

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.table, position, k.name, k.dtype, k.nullable, k.unique,
             list(k.allowed_values) if k.allowed_values else None, k.description)
            for c in self.contracts.values()
            for position, k in enumerate(c.columns)
        ]
        return config_frame(
            spark,
            rows,
            "table string, ordinal int, column string, dtype string, nullable boolean,"
            " unique boolean, allowed_values array<string>, description string",
        )

    def foreign_keys_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.table, *key) for c in self.contracts.values() for key in c.foreign_keys]
        return config_frame(
            spark,
            rows, "table string, column string, ref_table string, ref_column string"
        )

    def checks_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n, s.check_id, s.table, s.column, s.dimension, s.contract_id, s.description,
             s.contains, s.window_start_column, s.window_end_column, list(s.business_key),
             len(self.contract(s.table).columns),
             s.policies[0].action_id if s.policies else None)
            for n, s in enumerate(self.checks.values())
        ]
        return config_frame(
            spark,
            rows,
            "ordinal int, check_id string, table string, column string, dimension string,"
            " contract_id string, description string, contains string, window_start string,"
            " window_end string, business_key array<string>, contract_columns int,"
            " default_action string",
        )

    def policies_frame(self, spark: SparkSession) -> DataFrame:
        """One row per declared (check, action) with its derived parameters and fingerprint."""
        rows = []
        for spec in self.checks.values():
            for position, policy in enumerate(spec.policies):
                rule = ACTIONS[policy.action_id]
                rows.append(
                    (spec.check_id, position, policy.action_id, spec.table,
                     canonical_json(self.policy_params(spec, policy.action_id)), rule.mutates, rule.rank,
                     rule.reversible, self.policy_fingerprint(spec.check_id, policy.action_id))
                )
        return config_frame(
            spark,
            rows,
            "check_id string, ordinal int, action_id string, table string, params string,"
            " mutates boolean, rank string, reversible boolean, policy_fingerprint string",
        )

    def actions_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.action_id, r.mutates, r.rank, DESTRUCTIVE_RANKS[r.rank], r.reversible,
             list(r.required),
             sorted(self.action_tables[r.action_id]) if r.action_id in self.action_tables else None)
            for r in ACTIONS.values()
        ]
        return config_frame(
            spark,
            rows,
            "action_id string, mutates boolean, rank string, rank_weight double,"
            " reversible boolean, required_params array<string>, allowed_tables array<string>",
        )

    def policy_fingerprint(self, check_id: str, action_id: str) -> str:
        """Digest of all declarations one (check, action) depends on, parents included."""
        spec = self.check(check_id)
        contract = self.contract(spec.table)
        key = contract.foreign_key(spec.column) if action_id == "quarantine_orphans" else None
        parent = self.contracts.get(key[1]) if key else None
        return json_digest(
            {
                "contract": _plain(contract),
                "referenced_contract": _plain(parent) if parent else None,
                "check": _plain(spec),
                "action": _plain(ACTIONS[action_id]),
                "allowed_tables": sorted(self.action_tables.get(action_id, ())),
                "rules_version": RULES_VERSION,
            }
        )




def _plain(value: Any) -> Any:
    """Dataclasses, mappings and tuples as JSON-ready values."""
    if hasattr(value, "__dataclass_fields__"):
        return {item.name: _plain(getattr(value, item.name)) for item in fields(value)}
    if isinstance(value, Mapping):
        return {key: _plain(item) for key, item in value.items()}
    if isinstance(value, (tuple, list)):
        return [_plain(item) for item in value]
    return value.isoformat() if isinstance(value, date) else value


def canonical_json(value: Any) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"))


def _read_document(source: Path) -> Mapping[str, Any]:
    text = source.read_text(encoding="utf-8")
    try:
        if source.suffix == ".json":
            document = json.loads(text)
        else:
            import yaml

            document = yaml.safe_load(text)
    except ImportError:
        raise ContractError(f"{source}: PyYAML is not installed; use a .json registry") from None
    except ValueError as exc:
        raise ContractError(f"{source}: {exc}") from None
    except Exception as exc:  # yaml.YAMLError, which exists only when yaml does
        if type(exc).__module__.split(".")[0] != "yaml":
            raise
        raise ContractError(f"{source}: {exc}") from None
    if document is None:
        return {}
    if not isinstance(document, Mapping):
        raise ContractError(f"{source}: document must be a mapping")
    return document


def _record(cls: type, raw: Any, **converted: Any) -> Any:
    if not isinstance(raw, Mapping):
        raise ContractError("must be a mapping")
    known = {item.name for item in fields(cls)}
    values = {key: value for key, value in raw.items() if key in known and value is not None}
    values.update({key: value for key, value in converted.items() if value is not None})
    try:
        return cls(**values)
    except TypeError as exc:
        missing = str(exc).rsplit("argument", 1)[-1].strip(" s:'")
        raise ContractError("field required", missing.split("'")[0]) from None


def _sequence(raw: Any, path: str) -> list[Any]:
    if raw is None:
        return []
    if not isinstance(raw, (list, tuple)):
        raise ContractError("must be a list", path)
    return list(raw)


def _table_from(raw: Any) -> TableContract:
    if not isinstance(raw, Mapping):
        raise ContractError("must be a mapping")
    columns = []
    for position, item in enumerate(_sequence(raw.get("columns"), "columns")):
        allowed = item.get("allowed_values") if isinstance(item, Mapping) else None
        try:
            columns.append(
                _record(ColumnContract, item, allowed_values=tuple(allowed) if allowed else None)
            )
        except ContractError as exc:
            tail = f".{exc.path}" if exc.path else ""
            raise ContractError(str(exc), f"columns.{position}{tail}") from None
    return _record(
        TableContract,
        raw,
        columns=tuple(columns),
        primary_key=tuple(_sequence(raw.get("primary_key"), "primary_key")),
        foreign_keys=tuple(
            tuple(_sequence(key, f"foreign_keys.{position}"))
            for position, key in enumerate(_sequence(raw.get("foreign_keys"), "foreign_keys"))
        ),
    )


def _check_from(raw: Any) -> CheckSpec:
    if not isinstance(raw, Mapping):
        raise ContractError("must be a mapping")
    policies = []
    for position, item in enumerate(_sequence(raw.get("policies"), "policies")):
        if not isinstance(item, Mapping) or not item.get("action_id"):
            raise ContractError("field required", f"policies.{position}.action_id")
        parameters = {
            name: tuple(value) if isinstance(value, list) else value
            for name, value in (item.get("parameters") or {}).items()
        }
        policies.append(CheckPolicy(item["action_id"], MappingProxyType(parameters)))
    return _record(
        CheckSpec,
        raw,
        policies=tuple(policies),
        business_key=tuple(_sequence(raw.get("business_key"), "business_key")),
    )
