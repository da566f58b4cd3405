"""Contracts: what the columns of a dataset have to satisfy."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidContract

#: Rules in the order in which their findings come within a cell.
RULES = ("required", "not_null", "unique", "min", "max", "pattern", "allowed")
MAX_FINDINGS = 100


@dataclass(frozen=True)
class ColumnRules:
    required: bool = False
    not_null: bool = False
    unique: bool = False
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    allowed: frozenset[str] | None = None


@dataclass(frozen=True)
class Contract:
    columns: dict[str, ColumnRules] = field(default_factory=dict)
    max_findings: int = MAX_FINDINGS


def parse(source: Contract | Mapping | str | bytes) -> Contract:
    """A contract from a mapping or JSON text. Keys that aren't known are ignored."""
    if isinstance(source, Contract):
        return source
    if isinstance(source, (str, bytes)):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise InvalidContract(f"contract is no JSON: {e}") from None
    if not isinstance(source, Mapping):
        raise InvalidContract("a contract is an object")
    most = source.get("max_findings", MAX_FINDINGS)
    if isinstance(most, bool) or not isinstance(most, int) or most < 0:
        raise InvalidContract("max_findings is a whole number from 0")
    columns = source.get("columns", {})
    if not isinstance(columns, Mapping):
        raise InvalidContract("columns is an object")
    return Contract({str(name): _rules(str(name), rules) for name, rules in columns.items()}, most)


def _rules(name: str, rules: Any) -> ColumnRules:
    if not isinstance(rules, Mapping):
        raise InvalidContract(f"rules of column `{name}` are an object")
    out: dict[str, Any] = {}
    for rule in ("required", "not_null", "unique"):
        value = rules.get(rule, False)
        if not isinstance(value, bool):
            raise InvalidContract(f"`{rule}` of column `{name}` is true or false")
        out[rule] = value
    for rule in ("min", "max"):
        value = rules.get(rule)
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
            raise InvalidContract(f"`{rule}` of column `{name}` is a number")
        out[rule] = None if value is None else float(value)
    pattern = rules.get("pattern")
    if pattern is not None and not isinstance(pattern, str):
        raise InvalidContract(f"`pattern` of column `{name}` is a string")
    allowed = rules.get("allowed")
    if allowed is not None and (isinstance(allowed, (str, bytes, Mapping)) or not all(isinstance(x, str) for x in allowed)):
        raise InvalidContract(f"`allowed` of column `{name}` is a list of strings")
    return ColumnRules(**out, pattern=pattern, allowed=None if allowed is None else frozenset(allowed))
